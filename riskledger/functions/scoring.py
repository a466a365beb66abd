"""Risk score, severity and classification as column expressions over artifact rows.

All of it is per row: weights are a literal map, signals an ordered array, so scoring never
shuffles.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskledger.catalog import labels as L, names, weights as W
from riskledger.functions.sqltext import literal_map, str_array


def lookup(values: dict, key: Column, default=None) -> Column:
    found = F.element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def has_prefix(signals: Column, prefix: str) -> Column:
    return F.exists(signals, lambda s: s.startswith(prefix))


def _suppressed(signals: Column):
    """The plain credential flag does not count next to a structured secret."""
    structured = has_prefix(signals, "secret:")
    return lambda s: structured & (s == "credential_exposure_signal")


def _count_weight(signal: Column) -> Column:
    out = F.lit(None).cast("int")
    for prefix, factor, maximum in W.COUNT_WEIGHTS:
        number = F.regexp_extract(signal, rf"^{prefix}([+-]?[0-9]{{1,9}})$", 1)
        out = F.coalesce(F.when(signal.startswith(prefix) & (number != ""),
                                F.least(F.lit(maximum), number.cast("int") * factor)), out)
    return out


def signal_weight(signal: Column, declared: Column) -> Column:
    full = F.coalesce(
        F.element_at(literal_map(W.RISK_WEIGHTS), signal),
        F.when(signal.startswith(W.CRYPTO_PREFIX), F.lit(W.CRYPTO_WEIGHT)),
        _count_weight(signal),
    )
    tool = F.element_at(literal_map(W.DECLARED_TOOL), signal)
    known = tool.isNotNull() & F.array_contains(declared, tool)
    return F.when(known, F.floor(full * W.DECLARED_DISCOUNT).cast("int")).otherwise(full)


def contributions(signals: Column, declared: Column) -> Column:
    """Ordered ``struct(weight, position, signal)`` of the signals that count."""
    skip = _suppressed(signals)
    rows = F.transform(signals, lambda s, i: F.struct(
        F.when(~skip(s), signal_weight(s, declared)).alias("weight"), i.alias("position"),
        s.alias("signal")))
    return F.filter(rows, lambda r: r["weight"].isNotNull())


def risk_score(artifact_type: Column, parts: Column) -> Column:
    total = F.aggregate(parts, lookup(W.TYPE_BASE, artifact_type, W.TYPE_BASE_DEFAULT),
                        lambda acc, r: acc + r["weight"])
    return F.least(F.lit(100), total)


def top_reasons(parts: Column, n: int = 2) -> Column:
    """Heaviest contributions; equal weights keep signal order."""
    ranked = F.array_sort(F.transform(parts, lambda r: F.struct(
        (-r["weight"]).alias("w"), r["position"].alias("p"), r["signal"].alias("s"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: F.concat(
        r["s"], F.lit(" (+"), (-r["w"]).cast("string"), F.lit(")")))


def local_policy_score(artifact_type: Column, signals: Column) -> Column:
    skip = _suppressed(signals)
    base = lookup(W.LOCAL_TYPE_BASE, artifact_type, W.LOCAL_TYPE_BASE_DEFAULT)
    weight = lambda s: F.coalesce(F.element_at(literal_map(W.LOCAL_WEIGHTS), s),
                                  F.when(s.startswith(W.CRYPTO_PREFIX), F.lit(W.CRYPTO_WEIGHT)),
                                  F.lit(0))
    total = F.aggregate(signals, base,
                        lambda acc, s: acc + F.when(skip(s), F.lit(0)).otherwise(weight(s)))
    return F.least(F.lit(100), total)


def severity_band(score: Column) -> Column:
    out = F.when(score >= W.SEVERITY_BANDS[0][1], W.SEVERITY_BANDS[0][0])
    for name, minimum in W.SEVERITY_BANDS[1:]:
        out = out.when(score >= minimum, name)
    return out.otherwise("info")


def severity_rank(status: Column) -> Column:
    return lookup(W.SEVERITY_RANK, status, 0)


def min_score_of(level: str) -> int:
    return dict(W.SEVERITY_BANDS).get(level, 0)


def verify(score: Column, signals: Column, governed: Column) -> Column:
    """Severity: credential flag first, then score bands raised by dangerous signals."""
    band = severity_band(score)
    rank = severity_rank(band)
    keyword, combo = has_prefix(signals, "dangerous_keyword:"), has_prefix(signals, "dangerous_combo:")

    def at_least(level):
        return F.when(rank >= W.SEVERITY_RANK[level], band).otherwise(F.lit(level))

    return (F.when(F.array_contains(signals, "credential_exposure_signal"), "critical")
            .when(keyword & governed, at_least("medium"))
            .when(keyword, at_least("high"))
            .when(combo, at_least("medium"))
            .otherwise(band))


def governed(*lists: Column) -> Column:
    out = F.lit(False)
    for lst in lists:
        out = out | F.coalesce(F.size(lst) > 0, F.lit(False))
    return out


def artifact_scope(artifact_type: Column, path: Column, origin: Column, mode: str) -> Column:
    in_docs = F.arrays_overlap(F.split(F.lower(path), "/"), str_array(names.DOC_PARTS))
    return (F.when(artifact_type == "browser_footprint", "host")
            .when(artifact_type.isin("container_config", "container_candidate"), "container")
            .when(in_docs, "docs")
            .when(F.lit(mode == "host") | (origin == "host"), "host")
            .otherwise("project"))


def registry_eligible(artifact_type: Column, scope: Column, signals: Column, confidence: Column) -> Column:
    return (F.when(artifact_type.isin("cursor_rules", "agents_md", "container_config"), True)
            .when(artifact_type.isin("source_risk_surface", "container_candidate"), False)
            .when((artifact_type == "prompt_config") & (scope == "docs"), False)
            .when(artifact_type == "prompt_config",
                  has_prefix(signals, "keyword:") | (confidence >= 0.85))
            .otherwise(confidence >= 0.6))


def analysis_origin(artifact_type: Column, signals: Column, status: Column) -> Column:
    listed = F.arrays_overlap(signals, str_array(L.LOCAL_ANALYSIS_SIGNALS))
    local = (artifact_type == "source_risk_surface") | listed | status.isin("critical", "high")
    for prefix in L.LOCAL_ANALYSIS_PREFIXES:
        local = local | has_prefix(signals, prefix)
    return F.when(local, "local").otherwise("server_candidate")


def capabilities(signals: Column) -> Column:
    mapped = F.transform(signals, lambda s: F.element_at(literal_map(L.CAPABILITY), s))
    return F.array_sort(F.array_distinct(F.filter(mapped, lambda c: c.isNotNull())))


def capability_level(capability: Column) -> Column:
    return lookup(L.CAPABILITY_LEVEL, capability, "info")


def capability_label(capability: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(L.CAPABILITY_LABEL), capability),
                      F.replace(capability, F.lit("_"), F.lit(" ")))


def reason_label(reason: Column) -> Column:
    key = F.substring_index(reason, " (+", 1)
    exact = F.element_at(literal_map(L.REASON_LABELS), key)
    out = F.when(exact.isNotNull(), exact)
    for prefix, label in L.REASON_PREFIX_LABELS:
        out = out.when(key.startswith(prefix), label)
    return out.otherwise(reason)


def severity_label(score: Column) -> Column:
    return F.upper(severity_band(score))
