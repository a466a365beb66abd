"""Rule matching and rule application."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from riskledger.functions import signals as G
from riskledger.functions.regex import to_java
from riskledger.operators.corpus import any_of, salted_join
from riskledger.session import cut, kept
from riskledger.sources.rules import BLOCKS


#: Rules that meet a text at a time, where rules come as a frame.
RULES_A_LIST = 1000


def glob_to_java(glob: str) -> str:
    """``*`` and ``?`` wildcards over a file name; ``[...]`` sets stay sets."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1:close]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_anchor(glob: str) -> tuple[str, str]:
    """The longer of a glob's literal tail (``s``) and head (``p``), by which names look it up."""
    wild = [i for i, ch in enumerate(glob) if ch in "*?[]"]
    head, tail = glob[:wild[0]], glob[wild[-1] + 1:]
    return ("s", tail) if len(tail) >= len(head) else ("p", head)


def rule_keys(rule: dict) -> list[str]:
    """Where a rule is looked up: ``e`` whole names, ``s`` endings, ``p`` beginnings, ``s`` alone for any name."""
    keys = {f"e{f.lower()}" for f in rule["filenames"] if "*" not in f} | {f"s{x.lower()}" for x in rule["suffixes"]}
    return sorted(keys | {"".join(glob_anchor(f.lower())) for f in rule["filenames"] if "*" in f})


def _hits(lower: Column, rules: list[dict]) -> list[Column]:
    """For each kind and length of key: the name's key of that length if any rule has it, else NULL."""
    found: dict[tuple, set] = {}
    for rule in rules:
        for key in rule_keys(rule):
            found.setdefault((key[0], 0 if key[0] == "e" else len(key) - 1), set()).add(key[1:])
    out = []
    for (kind, size), words in sorted(found.items()):
        part = lower if kind == "e" else F.right(lower, F.lit(size)) if kind == "s" else F.left(lower, F.lit(size))
        out.append(F.when(part.isin(sorted(words)), F.concat(F.lit(kind), part)))
    return out


def matches_any(name: Column, rules: list[dict]) -> Column:
    """May any rule fit the name?  Hash look-ups only; globs are not tried in full."""
    return any_of([hit.isNotNull() for hit in _hits(F.lower(name), rules)])


def match_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """A row for each file and rule that fits its ``name``: the rule's columns, and ``match_kind`` (0 exact
    name, 1 suffix, 2 glob; a rule counts once, under the first kind that fits).

    Names meet rules in an equality on look-up keys, however many rules there are; a glob is tried in
    full only where its literal head or tail fits.  The rules, which the driver holds, go to the files: a shuffle
    by key would bring all texts of a common name to one task.
    """
    lower = F.lower("name")
    keyed = files.withColumn("_keys", F.array_compact(F.array(*_hits(lower, rules)))).withColumn("_key", F.explode("_keys"))
    table = rule_table(files.sparkSession, rules)
    met = _first_meeting(keyed.drop("_keys").join(F.broadcast(table.withColumn("_key", F.explode("rule_keys"))), "_key"), lower)
    return met.drop("_key", "rule_keys", "exact", "endings", "globs")


def _first_meeting(met: DataFrame, lower: Column) -> DataFrame:
    """Of names that met rules by key: one row a name and rule that fits, with ``match_kind``."""
    def fits(key):
        kind, part = F.left(key, F.lit(1)), F.substr(key, F.lit(2))
        return F.when(kind == "e", lower == part).when(kind == "s", lower.endswith(part)).otherwise(lower.startswith(part))

    kind = (F.when(F.array_contains("exact", lower), 0).when(F.exists("endings", lambda x: lower.endswith(x)), 1)
            .when(F.exists("globs", lambda x: F.rlike(lower, x)), 2))
    tried = G.computed_once(met, match_kind=kind, _first=F.filter("rule_keys", fits)[0])
    return tried.where("match_kind is not null and _key = _first").drop("_first")


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The accepted rules as a table with their look-up keys and the JVM spelling of their expressions."""
    rows = []
    for r in rules:
        names, globs = ([f.lower() for f in r["filenames"] if ("*" in f) == wild] for wild in (False, True))
        row = [r["rule_rank"], r["name"], r["artifact_type"], r["confidence"], rule_keys(r), names,
               [x.lower() for x in r["suffixes"]], [glob_to_java(g) for g in globs]]
        for block in BLOCKS:
            b = r[block]
            row.append(None if b is None else (
                b["terms"], [to_java(t) for t in b["terms"]] if "patterns" in block else [],
                b["signals_prefix"], b["boost_confidence"], b["boost_threshold"]))
        rows.append(tuple(row))
    block = "struct<terms:array<string>,jvm:array<string>,prefix:string,boost:double,threshold:int>"
    schema = ("rule_rank int, rule_name string, artifact_type string, match_confidence double, "
              "rule_keys array<string>, exact array<string>, endings array<string>, globs array<string>, "
              + ", ".join(f"{b} {block}" for b in BLOCKS))
    return spark.createDataFrame(rows, schema)


_STRINGS = ArrayType(StringType())


@F.pandas_udf(StructType([StructField(c, _STRINGS) for c in ("rule_keys", "exact", "endings", "globs")]))
def _looked_up(filenames: pd.Series, suffixes: pd.Series) -> pd.DataFrame:
    rows = []
    for names, endings in zip(filenames, suffixes):
        names, endings = [] if names is None else list(names), [] if endings is None else list(endings)
        plain, globs = ([f.lower() for f in names if ("*" in f) == wild] for wild in (False, True))
        rows.append((rule_keys({"filenames": names, "suffixes": endings}), plain, [x.lower() for x in endings],
                     [glob_to_java(g) for g in globs]))
    return pd.DataFrame(rows, columns=["rule_keys", "exact", "endings", "globs"])


@F.pandas_udf(_STRINGS)
def _jvm_spelling(terms: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else [to_java(t) for t in ts] for ts in terms], dtype=object)


def rule_frame(rules: DataFrame) -> DataFrame:
    """The table of :func:`rule_table` from a frame of accepted rules, which stays one."""
    out = rules.withColumn("_keys", _looked_up("filenames", "suffixes"))
    for block in BLOCKS:
        b = F.col(block)
        jvm = _jvm_spelling(b["terms"]) if "patterns" in block else F.array().cast("array<string>")
        out = out.withColumn(block, F.when(b.isNotNull(), F.struct(
            b["terms"].alias("terms"), jvm.alias("jvm"), b["signals_prefix"].alias("prefix"),
            b["boost_confidence"].alias("boost"), b["boost_threshold"].alias("threshold"))))
    return out.select("rule_rank", F.col("name").alias("rule_name"), "artifact_type",
                      F.col("confidence").alias("match_confidence"), "_keys.*", *BLOCKS)


def _rules_of_names(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, _rules``: the rules of a frame that fit each distinct name, with ``match_kind``, in lists of at most
    ``RULES_A_LIST`` (several rows a name, if more fit).

    A name meets rules in an equality on all its beginnings and endings.
    """
    lower = F.lower("name")
    sizes = F.sequence(F.lit(0), F.length(lower))
    keys = F.concat(F.array(F.concat(F.lit("e"), lower)), F.transform(sizes, lambda n: F.concat(F.lit("s"), F.right(lower, n))),
                    F.transform(sizes, lambda n: F.concat(F.lit("p"), F.left(lower, n))))
    keyed = names.select("name").where("name is not null").distinct().withColumn("_key", F.explode(keys))
    met = keyed.join(rule_frame(rules).withColumn("_key", F.explode("rule_keys")), "_key")
    fit = _first_meeting(met, lower)
    at = F.row_number().over(Window.partitionBy("name").orderBy("rule_rank"))
    item = F.struct("rule_rank", "rule_name", "artifact_type", "match_confidence", *BLOCKS, "match_kind")
    return (fit.withColumn("_list", F.floor((at - 1) / RULES_A_LIST)).groupBy("name", "_list")
            .agg(F.collect_list(item).alias("_rules")).drop("_list"))


def apply_rules(files: DataFrame, rules: list[dict] | DataFrame, deep: bool, content_gate: bool = True) -> DataFrame:
    """One row per file and matching rule with ``rule_name, artifact_type, confidence, signals``.

    ``files`` needs ``name, text, content_ok``.  Texts are scanned once per file (and list of ``RULES_A_LIST``
    rules), before rows multiply by rule.  ``rules`` are accepted rules, as rows the driver holds or as a frame
    (:func:`riskledger.sources.rules.accepted_rules`) that is neither collected nor written into the plan.
    """
    readable = F.col("text").isNotNull() & (F.col("content_ok") if content_gate else F.lit(True))
    whole = isinstance(rules, list)
    known = files.where(matches_any(F.col("name"), rules)) if whole else files.join(_rules_of_names(files, rules), "name")
    scanned = G.with_signals(known, "text", readable).withColumn("_low", F.lower("text"))
    per_rule = match_rules(scanned, rules) if whole else scanned.select("*", F.inline("_rules")).drop("_rules")
    text = F.when(readable, F.col("text"))
    none = F.array().cast("array<string>")
    used = [b for b in BLOCKS if deep or not b.startswith("deep_")]
    order = [b for b in ("keywords", "patterns", "deep_keywords", "deep_patterns") if b in used]
    for b in order:
        block = F.col(b)
        found = (G.keyword_signals(F.col("_low"), block["terms"], block["prefix"]) if "keywords" in b
                 else G.regex_signals(text, block["terms"], block["jvm"], block["prefix"]))
        per_rule = per_rule.withColumn(f"_{b}", F.coalesce(F.when(text.isNotNull(), found), none))
    confidence = F.col("match_confidence")
    for b in order:
        block = F.col(b)
        reached = text.isNotNull() & (F.size(f"_{b}") >= block["threshold"])
        confidence = F.greatest(confidence, F.when(reached, block["boost"]))
    signals = F.concat(F.array(F.concat(F.lit("filename_match:"), F.col("name"))),
                       *[F.col(f"_{b}") for b in order], F.col("secret_signals"), F.col("danger_signals"))
    return (per_rule.withColumn("confidence", F.least(F.lit(1.0), confidence))
            .withColumn("signals", signals)
            .drop("_low", *BLOCKS, *[f"_{b}" for b in order], "match_confidence", "secret_signals",
                  "dangerous_signals", "ssrf_signals", "tampering_signals", "danger_signals"))


GRAM = 4
#: Bits of the table that says which runs of characters are looked for (128 KB).
GRAM_BITS = 1 << 20
#: Rules of a term that go to a text in one row.
POSTINGS = 1000


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _wanted_bits(grams: DataFrame) -> DataFrame:
    """One row with ``_bits``: a table of ``GRAM_BITS`` bits with those of the wanted runs set.  Its size does not
    depend on their number."""
    slot = F.pmod(F.xxhash64("_gram"), F.lit(GRAM_BITS))
    words = (grams.select(F.floor(slot / 64).cast("long").alias("id"), F.pmod(slot, F.lit(64)).cast("int").alias("at")).distinct()
             .groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("w")))
    every = grams.sparkSession.range(GRAM_BITS // 64).join(words, "id", "left")
    cells = F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))))
    return every.agg(F.transform(cells, lambda c: c["w"]).alias("_bits"))


def _wanted(gram: Column) -> Column:
    slot = F.pmod(F.xxhash64(gram), F.lit(GRAM_BITS))
    return F.getbit(F.get("_bits", F.floor(slot / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1


def term_hits(texts: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """``keys, term``: every term that occurs in a text, case aside, for any number of terms.

    ``texts``: ``keys, text``; ``terms``: ``term``.  A term is looked up by the run of ``GRAM`` characters in it
    that the fewest texts hold (a shorter term by itself); a term with a run that no text holds is in none.  Runs of
    texts meet those keys in an equality, and only such meetings are tested in full, so the cost follows the texts and
    the hits and not texts x terms.
    Null and empty terms occur nowhere.

    Runs of texts are never shuffled with their texts' keys but for those looked for: they are counted with a
    combiner first, and a table of bits drops nearly all others before the equality.  Only runs as long as some term
    needs are looked at (``GRAM`` numbers at most, which the driver reads).
    """
    words = terms.select("term", F.lower("term").alias("_low")).where("_low <> ''").distinct()
    texts = texts.select(*keys, F.lower("text").alias("_text"))
    sizes = sorted(r.size for r in words.select(F.least(F.length("_low"), F.lit(GRAM)).alias("size")).distinct().collect()) or [GRAM]
    in_terms = None
    for size in sizes:
        sized = words.where(F.least(F.length("_low"), F.lit(GRAM)) == size)
        a = sized.select("term", "_low", F.explode(_grams(F.col("_low"), size)).alias("_gram"))
        in_terms = a if in_terms is None else in_terms.unionByName(a)
    grams = F.concat(*[_grams(F.col("_text"), size) for size in sizes])
    spread = texts.select(F.explode(grams).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_texts"))
    rarest = cut(in_terms.join(spread, "_gram", "left").groupBy("term", "_low")
                 .agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_m"))
                 .where("_m.n > 0").select("term", "_low", F.col("_m.g").alias("_gram")))
    sought = texts.crossJoin(F.broadcast(_wanted_bits(rarest))).select(*keys, F.explode(F.filter(grams, _wanted)).alias("_gram"))
    whole = F.col("_gram") == F.col("_low")
    likely = salted_join(sought, rarest, ["_gram"], keys).select(*keys, "term", "_low", whole.alias("_whole"))
    return likely.join(texts, keys).where(F.col("_whole") | F.contains("_text", F.col("_low"))).select(*keys, "term").distinct()


def term_rules(texts: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """``keys, rule_rank, confidence, signals`` of each text and each keyword rule with a hit in it.

    ``rules``: ``rule_rank, terms, prefix, confidence, boost, threshold``, a frame that stays one: rules are
    neither collected nor written into the plan.  Signals follow the order of a rule's terms; the boost counts
    once the threshold is reached.

    In most texts a rule has one term only, the one that the most texts hold.  Its rows are known beforehand, so a hit
    meets them in lists that become rows where they are met: rows of texts and rules are never shuffled.  Only texts
    that hold another term of a rule are put together by text and rule, and are left out of the lists.
    """
    rules = cut(rules.where("rule_rank is not null"))
    each = rules.select("rule_rank", F.posexplode("terms").alias("_at", "term"))
    hits = kept(term_hits(texts, keys, each.select("term")))
    often = hits.groupBy("term").agg(F.count("*").alias("_n"))
    places = (each.distinct().join(often.hint("merge"), "term").groupBy("rule_rank", "term")
              .agg(F.array_sort(F.collect_list("_at")).alias("_ats"), F.first("_n").alias("_n")))
    ways = rules.groupBy("rule_rank").agg(F.collect_list(F.struct("prefix", "confidence", "boost", "threshold")).alias("_ways"))
    first = places.groupBy("rule_rank").agg(F.max(F.struct("_n", "term", "_ats")).alias("_m"))
    first = (first.select("rule_rank", F.col("_m.term").alias("_main"), F.col("_m._ats").alias("_main_ats")).join(ways.hint("merge"), "rule_rank")
             .withColumn("_pos", F.row_number().over(Window.partitionBy("_main").orderBy("rule_rank")) - 1))
    first = kept(first)

    def confidence(hits_):
        return F.greatest("confidence", F.when(hits_ >= F.col("threshold"), F.col("boost"))).alias("confidence")

    others = places.join(first.hint("merge"), "rule_rank").where("term <> _main").select(
        "term", "rule_rank", F.struct("_main", "_main_ats", "_pos", "_ways").alias("_rule"),
        F.transform("_ats", lambda at: F.struct(at.alias("_at"), F.col("term").alias("term"))).alias("_met"))
    several = salted_join(hits, others, ["term"], keys).groupBy(*keys, "rule_rank").agg(
        F.flatten(F.collect_list("_met")).alias("_met"), F.first("_rule").alias("_rule")).select(*keys, "rule_rank", "_met", "_rule.*")
    mains = hits.select(*keys, F.col("term").alias("_main"), F.lit(True).alias("_too"))
    several = kept(several.join(mains.hint("merge"), [*keys, "_main"], "left"))
    with_main = F.when(F.col("_too"), F.transform("_main_ats", lambda at: F.struct(at.alias("_at"), F.col("_main").alias("term"))))
    together = several.withColumn("_met", F.array_sort(F.concat("_met", F.coalesce(with_main, F.array())))).select(*keys, "rule_rank", "_met", F.inline("_ways"))
    together = together.select(*keys, "rule_rank", confidence(F.size("_met")),
                               F.transform("_met", lambda h: F.concat("prefix", F.lit(":"), h["term"])).alias("signals"))

    out = several.where("_too").groupBy(*keys, F.col("_main").alias("term")).agg(F.collect_set("_pos").alias("_out"))
    alone = first.select("_main", "_main_ats", "_pos", "rule_rank", F.inline("_ways")).select(
        F.col("_main").alias("term"), "_pos", F.floor(F.col("_pos") / POSTINGS).alias("_list"), "rule_rank", confidence(F.size("_main_ats")),
        F.transform("_main_ats", lambda _: F.concat("prefix", F.lit(":"), "_main")).alias("signals"))
    lists = alone.groupBy("term", "_list").agg(F.collect_list(F.struct("_pos", "rule_rank", "confidence", "signals")).alias("_rules"))
    parts = 8 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = salted_join(hits.join(out.hint("merge"), [*keys, "term"], "left"), lists, ["term"], keys, parts=parts)
    here = F.when(F.col("_out").isNotNull(), F.filter("_out", lambda p: F.floor(p / POSTINGS) == F.col("_list")))
    rows = near.select(*keys, here.alias("_here"), "_rules").select(*keys, "_here", F.inline("_rules"))
    single = rows.where(F.col("_here").isNull() | ~F.array_contains("_here", F.col("_pos"))).select(*keys, "rule_rank", "confidence", "signals")
    return single.unionByName(together)
