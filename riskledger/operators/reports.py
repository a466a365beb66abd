"""Reports over scored artifacts.  Every ranking and example list works per scan (or over the
fleet) with bounded rows per group; counts are pre-aggregated before they shuffle."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskledger.functions import paths, scoring as S
from riskledger.operators.corpus import beyond_top_n, top_n

FLAGGED, CLEAR = ["critical", "high"], ["low", "info"]
VISIBLE = 3


def count_by(artifacts: DataFrame, key: str) -> DataFrame:
    """Counts per key, most frequent first, then by key."""
    return artifacts.groupBy(key).agg(F.count("*").alias("artifacts")).orderBy(F.desc("artifacts"), key)


def headline(artifacts: DataFrame, keys=("scan_id",), eligible_only: bool = False) -> DataFrame:
    """Flagged, review and clear counts; the summary form looks at registry-eligible rows only."""
    rows = artifacts.where("registry_eligible") if eligible_only else artifacts
    status = F.col("verification_status")
    return rows.groupBy(*keys).agg(
        F.count_if(status.isin(FLAGGED)).alias("flagged"), F.count_if(status == "medium").alias("review"),
        F.count_if(status.isin(CLEAR)).alias("clear"), F.count("*").alias("artifacts"))


def _riskiest() -> list[Column]:
    return [F.desc(S.severity_rank(F.col("verification_status"))), F.desc("risk_score"),
            F.asc("detector_rank"), F.asc("path"), F.asc("rule_order")]


def riskiest(artifacts: DataFrame, n: int = VISIBLE) -> DataFrame:
    """The ``n`` worst artifacts per scan: severity, then score, then artifact order."""
    return top_n(artifacts, ["scan_id"], _riskiest(), n, ["path", "rule_order"])


def remainder_by_directory(artifacts: DataFrame, n: int = VISIBLE) -> DataFrame:
    """Everything but the ``n`` worst, counted by directory and type: ``scan_id, dir,
    artifact_type, artifacts, dir_total``."""
    rows = artifacts.select("scan_id", "path", "rule_order", "artifact_type", "detector_rank", "verification_status", "risk_score")
    rest = beyond_top_n(rows, ["scan_id"], _riskiest(), n, ["path", "rule_order"])
    per_type = (rest.groupBy("scan_id", paths.parent_dir(F.col("path")).alias("dir"), "artifact_type")
                .agg(F.count("*").alias("artifacts")))
    totals = per_type.groupBy("scan_id", "dir").agg(F.sum("artifacts").alias("dir_total"))
    return per_type.join(totals, ["scan_id", "dir"])


def review_groups(artifacts: DataFrame, examples: int = 2) -> DataFrame:
    """Medium rows per top reason: count and the first example paths (by path)."""
    rows = artifacts.where("verification_status = 'medium'").select(
        "scan_id", "path", "rule_order", F.coalesce(
            S.reason_label(F.try_element_at("risk_reasons", F.lit(1))), F.lit("Other")).alias("reason"))
    keys, order = ["scan_id", "reason"], [F.asc("path"), F.asc("rule_order")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("path", "rule_order"), F.lit(32)))
    place = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    shares = salted.withColumn("_n", place).groupBy(*keys, "_salt").agg(
        F.count("*").alias("artifacts"), F.collect_list(F.when(F.col("_n") <= examples, F.struct("path", "rule_order"))).alias("e"))
    return shares.groupBy(*keys).agg(F.sum("artifacts").alias("artifacts"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e")).select(
        *keys, "artifacts", F.transform(F.slice("e", 1, examples), lambda x: x["path"]).alias("examples"))


def with_lite_rank(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumns({
        "local_score": S.local_policy_score(F.col("artifact_type"), F.col("signals")),
        "confidence_milli": (F.col("confidence") * 1000).cast("bigint")})


def _lite_order() -> list[Column]:
    return [F.desc("local_score"), F.desc("risk_score"), F.desc("confidence_milli"),
            F.asc("detector_rank"), F.asc("path"), F.asc("rule_order")]


def lite_visible(artifacts: DataFrame, n: int = VISIBLE) -> DataFrame:
    """The ``n`` artifacts a reduced report shows per scan, with their rank."""
    return top_n(with_lite_rank(artifacts), ["scan_id"], _lite_order(), n, ["path", "rule_order"])


def lite_hidden(artifacts: DataFrame, n: int = VISIBLE) -> DataFrame:
    """The other artifacts of a reduced report."""
    return beyond_top_n(with_lite_rank(artifacts), ["scan_id"], _lite_order(), n, ["path", "rule_order"])


def hidden_summary(hidden: DataFrame) -> DataFrame:
    """Counts by type, by status, by origin and in all, in one pass: ``scan_id, dimension, value,
    artifacts``."""
    grouped = hidden.withColumn("analysis_origin", F.coalesce("analysis_origin", F.lit("unknown"))).groupingSets(
        [["scan_id", "artifact_type"], ["scan_id", "verification_status"], ["scan_id", "analysis_origin"], ["scan_id"]],
        "scan_id", "artifact_type", "verification_status", "analysis_origin",
    ).agg(F.count("*").alias("artifacts"), F.grouping("artifact_type").alias("t"),
          F.grouping("verification_status").alias("s"), F.grouping("analysis_origin").alias("o"))
    dimension = (F.when(F.col("t") == 0, "by_type").when(F.col("s") == 0, "by_status")
                 .when(F.col("o") == 0, "by_origin").otherwise("count"))
    value = F.coalesce("artifact_type", "verification_status", "analysis_origin", F.lit(""))
    return grouped.select("scan_id", dimension.alias("dimension"), value.alias("value"), "artifacts")
