"""Detection rules: TOML files or rows in, validated rows out.

A rule table has one row per rule (see ``RULE_SCHEMA``).  Built-in rules come first, accepted
user rules after them; every rejected file, field and expression comes back as an error row.
"""

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.catalog import rules as R
from riskledger.functions.ambiguity import EXPONENTIAL, FOREIGN, TOO_LARGE, UNREADABLE, expression_faults

BLOCKS = ("keywords", "deep_keywords", "patterns", "deep_patterns")
_BLOCK = ("struct<terms:array<string>,signals_prefix:string,boost_confidence:double,"
          "boost_threshold:int>")
RULE_SCHEMA = (
    "rule_rank int, source string, name string, description string, artifact_type string, "
    "filenames array<string>, suffixes array<string>, confidence double, "
    + ", ".join(f"{b} {_BLOCK}" for b in BLOCKS))


ERROR_SCHEMA = "source string, rule_rank int, name string, field string, error string"


def _table(rule: dict, name: str) -> dict:
    value = rule.get(name, {})
    if not isinstance(value, dict):
        raise ValueError(f"{name}: must be a table")
    return value


def _strings(block: dict, name: str, where: str) -> list[str]:
    value = block.get(name, [])
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{where}.{name}: must be a list of strings")
    return value


def _block(rule: dict, name: str):
    if rule.get(name) is None:
        return None
    block = _table(rule, name)
    terms = _strings(block, "keywords" if "keywords" in name else "patterns", name)
    boost = block.get("boost_confidence")
    return (terms, block.get("signals_prefix", "keyword" if "keywords" in name else "pattern"),
            None if boost is None else float(boost), int(block.get("boost_threshold", 1)))


def rule_row(rule: dict, rank: int, source: str = "user") -> tuple:
    """A rule as a row; a rule that states no confidence has 0."""
    match, detector = _table(rule, "match"), _table(rule, "detector")
    return (rank, source, detector.get("name"), detector.get("description", ""),
            detector.get("artifact_type"), _strings(match, "filenames", "match"), _strings(match, "suffixes", "match"),
            float(match.get("confidence", 0.0)), *[_block(rule, b) for b in BLOCKS])


_COLUMNS = ["rule_rank", "source", "name", "description", "artifact_type", "filenames", "suffixes", "confidence",
            *BLOCKS]
_BLOCK_FIELDS = ["terms", "signals_prefix", "boost_confidence", "boost_threshold"]


def _as_dict(row: tuple) -> dict:
    out = dict(zip(_COLUMNS, row))
    for block in BLOCKS:
        if out[block] is not None:
            out[block] = dict(zip(_BLOCK_FIELDS, out[block]))
    return out


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [rule_row(r, i, "builtin") for i, r in enumerate(R.BUILTIN_RULES)], RULE_SCHEMA)


def toml_rules(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """``(rules, errors)`` of a folder's ``*.toml`` files.

    A file that cannot be read as a rule gives one error row and does not stop the others; links are
    not followed.
    """
    rows, errors = [], []
    for path in sorted(Path(directory).glob("*.toml")):
        if path.is_symlink() or not path.is_file():
            errors.append((path.name, None, None, "file", "is no plain file"))
            continue
        try:
            rows.append(rule_row(tomllib.loads(path.read_text(encoding="utf-8")), len(rows), path.name))
        except (tomllib.TOMLDecodeError, UnicodeDecodeError, TypeError, ValueError) as e:
            errors.append((path.name, None, None, "file", str(e)))
    return spark.createDataFrame(rows, RULE_SCHEMA), spark.createDataFrame(errors, ERROR_SCHEMA)


def _identifier(value: Column, longest: int, hyphen: bool) -> Column:
    tail = "[a-z0-9_-]" if hyphen else "[a-z0-9_]"
    return value.rlike(rf"\A[a-z]{tail}{{0,{longest - 1}}}\z")


def _bad_entries(values: Column, most: int, longest: int) -> Column:
    return ((F.size(values) > most)
            | F.exists(values, lambda v: (v == "") | (F.octet_length(v) > longest)
                       | v.rlike(r"(?U)\p{Cc}")))


def _compiles(expression: Column) -> Column:
    """Does the JVM accept the expression?  Only code points and a leading ``]`` are spelled otherwise."""
    spelled = F.regexp_replace(F.regexp_replace(expression, r"\\u\{([0-9A-Fa-f]+)\}", r"\\x{$1}"), r"\[(\^?)\]", r"[$1\\]")
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), spelled).isNotNull()


def _has_fault(terms: Column, faults: Column, fault: str) -> Column:
    """Has any expression that compiles this fault?"""
    marked = F.zip_with(terms, faults, lambda term, found: (found == fault) & _compiles(term))
    return F.exists(marked, lambda bad: F.coalesce(bad, F.lit(False)))


def _block_checks(name: str) -> list[tuple[Column, str, str]]:
    block = F.col(name)
    terms, prefix = block["terms"], block["signals_prefix"]
    words = "keywords" in name
    most, longest = (R.MAX_KEYWORDS, R.MAX_KEYWORD_LEN) if words else (R.MAX_PATTERNS, R.MAX_PATTERN_LEN)
    checks = [
        (F.size(terms) == 0, "terms", "must not be empty"),
        (_bad_entries(terms, most, longest), "terms", "too many, empty, too long or with control characters"),
        (~_identifier(prefix, R.MAX_PREFIX, False), "signals_prefix", "is not an identifier"),
        (prefix.isin(R.RESERVED_PREFIXES), "signals_prefix", "is reserved"),
        (block["boost_threshold"] < 1, "boost_threshold", "must be at least 1"),
        (block["boost_threshold"] > F.size(terms), "boost_threshold", "exceeds the number of terms"),
        (block["boost_confidence"].isNotNull() & ~block["boost_confidence"].between(0.0, 1.0),
         "boost_confidence", "must be between 0 and 1"),
    ]
    if not words:
        checks.append((F.exists(terms, lambda t: ~_compiles(t)), "terms", "does not compile"))
        checks += [(_has_fault(terms, F.col(f"_{name}_faults"), fault), "terms", fault)
                   for fault in (EXPONENTIAL, FOREIGN, UNREADABLE, TOO_LARGE)]
    return [(block.isNotNull() & bad, f"{name}.{field}", text) for bad, field, text in checks]


def rule_errors(rules: DataFrame) -> DataFrame:
    """``source, rule_rank, name, field, error``: one row per broken limit; valid rules give none.

    Expressions that a backtracking engine may not end on are refused (``functions.ambiguity``).
    """
    user = F.col("source") != "builtin"
    name, kind = F.col("name"), F.col("artifact_type")
    checks = [
        (~F.coalesce(_identifier(name, R.MAX_NAME, True), F.lit(False)), "name", "is not an identifier"),
        (~F.coalesce(_identifier(kind, R.MAX_TYPE, False), F.lit(False)), "artifact_type",
         "is not an identifier"),
        (user & kind.isin(R.RESERVED_TYPES), "artifact_type", "is reserved"),
        ((F.octet_length("description") > R.MAX_DESCRIPTION) | F.col("description").rlike(r"(?U)\p{Cc}"),
         "description", "too long or with control characters"),
        ((F.size("filenames") == 0) & (F.size("suffixes") == 0), "match", "needs filenames or suffixes"),
        (~F.col("confidence").between(0.0, 1.0), "match.confidence", "must be between 0 and 1"),
        (_bad_entries(F.col("filenames"), R.MAX_MATCH_ENTRIES, R.MAX_MATCH_LEN), "match.filenames",
         "too many, empty, too long or with control characters"),
        (_bad_entries(F.col("suffixes"), R.MAX_MATCH_ENTRIES, R.MAX_MATCH_LEN), "match.suffixes",
         "too many, empty, too long or with control characters"),
    ]
    for block in BLOCKS:
        checks += _block_checks(block)
    rules = rules.withColumns({f"_{b}_faults": expression_faults(F.col(b)["terms"]) for b in BLOCKS if "patterns" in b})
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(e).alias("error")))
                      for bad, f, e in checks])
    return (rules.select("source", "rule_rank", "name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e"))
            .select("source", "rule_rank", "name", "e.field", "e.error"))


def load_rules(spark: SparkSession, user: DataFrame | None = None):
    """``(rows, errors)``: accepted rules as plain rows, built-in first, and a frame of what is wrong
    with the rejected ones.

    Rules are configuration here: the driver holds them and operators join them.  Very many go as a frame
    (:func:`accepted_rules`).
    """
    accepted = [_as_dict(rule_row(r, i, "builtin")) for i, r in enumerate(R.BUILTIN_RULES)]
    errors = spark.createDataFrame([], ERROR_SCHEMA)
    if user is not None:
        errors = rule_errors(user)
        bad = {r.rule_rank for r in errors.select("rule_rank").distinct().collect()}
        rows = sorted(user.collect(), key=lambda r: r.rule_rank)
        accepted += [row.asDict(recursive=True) for row in rows if row.rule_rank not in bad]
    return [r | {"rule_rank": i} for i, r in enumerate(accepted)], errors


def accepted_rules(spark: SparkSession, user: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`load_rules`, with the accepted rules as a frame: nothing is collected, however many there are.

    Ranks of user rules keep their order and come after those of the built-in ones.
    """
    errors = rule_errors(user)
    bad = errors.select(F.col("rule_rank").alias("_bad")).distinct()
    kept = user.join(bad, F.col("rule_rank").eqNullSafe(F.col("_bad")), "left_anti")
    after = F.col("rule_rank") + F.lit(len(R.BUILTIN_RULES))
    return builtin_rules(spark).unionByName(kept.withColumn("rule_rank", after)), errors
