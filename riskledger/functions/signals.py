"""Text signals as column expressions.

A scan reads two columns, the text and its folded form (:func:`folded`), by name.  Each pattern
becomes ``anchor substring test AND regular expression``; plain-text patterns become the
substring test alone.  Expressions are written as SQL text, because hundreds of small column
calls would make building a plan slower than running it.  All of it is code-generated; only the
base64 re-scan needs higher-order functions, and it is guarded so that clean rows never reach
them.
"""

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskledger.catalog import names, patterns as P
from riskledger.functions.regex import ignores_case, literals_of, to_java
from riskledger.functions.sqltext import sql_str, sql_value

CREDENTIAL_FLAG = "credential_exposure_signal"
FAMILIES = ("secret", "dangerous", "ssrf", "tampering")


def folded(text: Column) -> Column:
    """Case-folded text for anchor tests (long s folds to s, as in case-insensitive matching)."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _any(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def _contains(text: str, words) -> str:
    """Substring test for any of ``words``; bytes are searched in the encoded text."""
    words = list(words)
    if len(words) > 3 and all(isinstance(w, str) and not w.isascii() for w in words):
        # single non-ASCII characters: look for their shared leading bytes first
        heads = {}
        for w in words:
            heads.setdefault(w.encode()[:2], []).append(w)
        return _any(f"({_contains(text, [head])} AND {_any(_contains(text, [w]) for w in group)})"
                    for head, group in heads.items())
    return _any(f"contains(CAST({text} AS BINARY), {sql_value(w)})" if isinstance(w, bytes)
                else f"contains({text}, {sql_str(w)})" for w in words)


# Marks that many anchors share.  One pass per mark decides for all of them, so a text without
# the mark skips every anchor that holds it.
GATES = ["://", "_", "-", "<", "[", "`", "=", "."]


def gate_tests(text: str) -> dict[str, str]:
    """Gate mark -> does the text hold it (the dot counts only next to a digit)."""
    return {g: f"rlike({text}, '[0-9][.][0-9]')" if g == "." else _contains(text, [g]) for g in GATES}


def _gate_for(words) -> str | None:
    for gate in GATES:
        if gate == "." and not all(re.fullmatch(r"[0-9.]*[0-9]\.[0-9.]*|\.[0-9]+", str(w)) for w in words):
            continue
        if words and all(isinstance(w, str) and gate in w for w in words):
            return gate
    return None


def _gated(test: str, words, gates) -> str:
    gate = _gate_for(words) if gates else None
    return f"({gates[gate]} AND {test})" if gate else test


def hit_sql(text: str, fold: str, expression: str, anchors=(), gates=None) -> str:
    """Does ``expression`` occur in ``text``?  SQL over the two names (or expressions)."""
    base = fold if ignores_case(expression) else text
    plain = literals_of(expression)
    if plain:
        words = [p.lower() for p in plain] if ignores_case(expression) else plain
        return _gated(_contains(base, words), words, gates)
    matched = f"rlike({text}, {sql_str(to_java(expression))})"
    return _gated(f"({_contains(base, anchors)} AND {matched})", anchors, gates) if anchors else matched


def hit(text: str, fold: str, expression: str, anchors=()) -> Column:
    return F.expr(hit_sql(text, fold, expression, anchors))


def _present(items) -> str:
    """Distinct non-null items in the order given."""
    return f"array_except(array({', '.join(items)}), array(CAST(NULL AS STRING)))"


def present(*items: Column) -> Column:
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


def _items(text, fold, table, gates=None):
    return [f"CASE WHEN {hit_sql(text, fold, e, a, gates)} THEN {sql_str(s)} END" for s, e, a in table]


def _legacy_sql(text, fold, gates=None) -> str:
    return _any(hit_sql(text, fold, e, a, gates) for _, e, a in P.LEGACY_SECRET_PATTERNS)


def legacy_secret_flag(text: str, fold: str) -> Column:
    return F.expr(_legacy_sql(text, fold))


def _combo_sql(fold: str) -> str:
    """One word of each group; the group that prose rarely meets is tested first."""
    return "(" + " AND ".join(_contains(fold, g) for g in reversed(P.COMBO_GROUPS)) + ")"


def combo_hit(fold: str) -> Column:
    return F.expr(_combo_sql(fold))


_B64 = "[" + string.ascii_letters + string.digits + "+/]"


def has_base64_run(text: str) -> str:
    """Is there a run of 32 base64 characters?  A class that lists its members is one table
    lookup per character for the JVM, and runs are tried at their start only."""
    return f"rlike({text}, '(?<!{_B64}){_B64}{{32}}')"


def base64_signals(text: str) -> Column:
    """Tampering signals hidden in strict base64 runs, in order of appearance."""
    tokens = f"filter(regexp_extract_all({text}, {sql_str(P.BASE64_TOKEN)}, 0), t -> length(t) % 4 = 0)"
    strict = f"filter({tokens}, t -> base64(unbase64(t)) = t)"
    texts = f"filter(transform({strict}, t -> try_validate_utf8(CAST(unbase64(t) AS STRING))), d -> d IS NOT NULL)"
    found = _present(_items("p.d", "p.f", P.TAMPERING_PATTERNS))
    pairs = f"transform({texts}, d -> named_struct('d', d, 'f', replace(lower(d), 'ſ', 's')))"
    hits = f"filter(transform({pairs}, p -> {found}), s -> size(s) > 0)"
    marked = f"transform({hits}, s -> concat(s, array({sql_str(P.BASE64_SIGNAL)})))"
    return F.expr(f"array_distinct(flatten({marked}))")


def computed_once(df, **columns: Column):
    """Add columns through a one-row generator.

    Filters on generated columns stay above the generator, so a later ``where`` on them does
    not make the optimizer repeat the whole computation below.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_signals(df, text: str = "text", content_ok: Column | None = None, families=FAMILIES):
    """Add ``<family>_signals`` for each family asked for, and ``danger_signals``, the
    dangerous, ssrf and tampering ones in one list.

    Rows whose ``content_ok`` is false (or whose text is NULL) get empty arrays.
    """
    body = F.col(text) if content_ok is None else F.when(content_ok, F.col(text))
    gated = df.withColumn("_scan", F.coalesce(body, F.lit("")))
    gated = gated.withColumn("_fold", folded(F.col("_scan")))
    t, f = "_scan", "_fold"
    gates = {g: f"_gate{i}" for i, g in enumerate(GATES)}
    gated = gated.select("*", *[F.expr(test).alias(gates[g]) for g, test in gate_tests(t).items()])
    parts = {}
    if "secret" in families:
        parts["_secrets"] = _present(_items(t, f, P.SECRET_PATTERNS, gates))
        parts["_legacy"] = _legacy_sql(t, f, gates)
    if "dangerous" in families:
        combo = f"CASE WHEN {_combo_sql(f)} THEN {sql_str(P.COMBO_SIGNAL)} END"
        parts["dangerous_signals"] = _present(_items(t, f, P.DANGEROUS_PATTERNS, gates) + [combo])
    if "ssrf" in families:
        parts["ssrf_signals"] = _present(_items(t, f, P.SSRF_PATTERNS, gates))
    if "tampering" in families:
        parts["_tampering"] = _present(_items(t, f, P.TAMPERING_PATTERNS, gates))
        parts["_encoded"] = has_base64_run(t)
    out = computed_once(gated, **{name: F.expr(sql) for name, sql in parts.items()})
    if "secret" in families:
        out = out.withColumn("secret_signals", F.when(
            F.col("_legacy") | (F.size("_secrets") > 0),
            F.concat(F.array(F.lit(CREDENTIAL_FLAG)), F.col("_secrets"))).otherwise(F.col("_secrets")))
    if "tampering" in families:
        hidden = F.when(F.col("_encoded"), base64_signals(t)).otherwise(F.array().cast("array<string>"))
        out = out.withColumn("tampering_signals", F.array_distinct(F.concat(F.col("_tampering"), hidden)))
    danger = [f"{n}_signals" for n in ("dangerous", "ssrf", "tampering") if n in families]
    if danger:
        out = out.withColumn("danger_signals", F.array_distinct(F.concat(*danger)))
    return out.drop("_scan", "_fold", *gates.values(), *[n for n in parts if n.startswith("_")])


def tokens_in(lowered: str, words, prefix: str = "") -> Column:
    """The words that occur in a lower-cased text column, in list order."""
    return F.expr(_present(f"CASE WHEN contains({lowered}, {sql_str(w)}) THEN {sql_str(prefix + w)} END"
                           for w in words))


def keyword_signals(lowered: Column, words: Column, prefix: Column) -> Column:
    """``prefix:word`` for every word of an array column that occurs in the lower-cased text."""
    hits = F.filter(words, lambda w: lowered.contains(F.lower(w)))
    return F.transform(hits, lambda w: F.concat(prefix, F.lit(":"), w))


def regex_signals(text: Column, expressions: Column, jvm: Column, prefix: Column) -> Column:
    """``prefix:expression`` for each matching expression; ``jvm`` holds the JVM spelling."""
    pairs = F.arrays_zip(expressions.alias("e"), jvm.alias("j"))
    hits = F.filter(pairs, lambda p: F.rlike(text, p["j"]))
    return F.transform(hits, lambda p: F.concat(prefix, F.lit(":"), p["e"]))


def urls(text: Column, expression: str) -> Column:
    return F.regexp_extract_all(text, F.lit(to_java(expression)), F.lit(0))


def env_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.ENV_VAR), F.lit(1))


def template_surface(text: Column) -> Column:
    return contains_any(F.lower(text), ["{{", "{%", "${"])


def user_input_surface(text: Column) -> Column:
    return contains_any(F.lower(text), ["user_input", "user_message"])


def env_marker(text: Column) -> Column:
    """The first kind of environment reference the text shows, else NULL."""
    return F.coalesce(*[F.when(text.contains(m), F.lit(m))
                        for m in ("$", "process.env.", "os.environ")])


def log_name_relevant(name: Column) -> Column:
    return name.endswith(".log") & contains_any(F.lower(name), names.LOG_NAME_TOKENS)
