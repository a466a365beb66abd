"""Reports over the artifacts of the derived files."""

from pyspark.sql import functions as F

from fleet_queries import artifact_sql as A, sqltext as S
from fleet_queries.artifacts import artifacts, joined
from fleet_queries.registry import query, quote
from riskledger.catalog import labels as L, weights as W
from riskledger.operators import reports as R
from riskledger.plans import scan as plan

ARTIFACTS = A.ARTIFACTS
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY srank DESC, risk_score DESC, detector_rank, path, rule_order) AS r
  FROM artifacts)"""
LITE = """lite AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY local_score DESC, risk_score DESC,
  CAST(trunc(confidence * 1000) AS BIGINT) DESC, detector_rank, path, rule_order) AS r FROM artifacts)"""


@query("count_by_type", f"{ARTIFACTS} SELECT artifact_type, count(*) AS artifacts FROM artifacts GROUP BY ALL")
def count_by_type(spark, sf):
    return R.count_by(artifacts(spark, sf), "artifact_type")


@query("posture_headline", f"""{ARTIFACTS} SELECT scan_id, form, CAST(count(*) FILTER (WHERE srank >= 4) AS BIGINT) AS flagged,
  CAST(count(*) FILTER (WHERE srank = 3) AS BIGINT) AS review, CAST(count(*) FILTER (WHERE srank < 3) AS BIGINT) AS clear, count(*) AS artifacts
  FROM (SELECT *, 'overview' AS form FROM artifacts UNION ALL SELECT *, 'summary' FROM artifacts WHERE registry_eligible) GROUP BY ALL""")
def posture_headline(spark, sf):
    forms = F.when(F.col("registry_eligible"), F.array(F.lit("overview"), F.lit("summary"))).otherwise(F.array(F.lit("overview")))
    return R.headline(artifacts(spark, sf).withColumn("form", F.explode(forms)), ["scan_id", "form"])


@query("minimum_severity_filter", f"""{ARTIFACTS} SELECT level, verification_status, count(*) AS artifacts FROM artifacts,
  (VALUES ('critical', 90), ('high', 70), ('medium', 40), ('low', 10)) t(level, least_score) WHERE risk_score >= least_score GROUP BY ALL""")
def minimum_severity(spark, sf):
    counts = artifacts(spark, sf).groupBy("verification_status", "risk_score").agg(F.count("*").alias("n"))
    levels = F.array(*[F.lit(level) for level, _ in W.SEVERITY_BANDS])
    kept = plan.filter_by_severity(counts.withColumn("level", F.explode(levels)), F.col("level"))
    return kept.groupBy("level", "verification_status").agg(F.sum("n").alias("artifacts"))


@query("riskiest_artifacts", f"{ARTIFACTS}, {RANKED} SELECT scan_id, CAST(r AS BIGINT) AS rank, path, artifact_type, verification_status, risk_score "
                             "FROM ranked WHERE r <= 3")
def riskiest(spark, sf):
    return R.riskiest(artifacts(spark, sf)).select(
        "scan_id", F.col("rank").cast("bigint").alias("rank"), "path", "artifact_type", "verification_status",
        F.col("risk_score").cast("bigint").alias("risk_score"))


@query("remainder_by_directory", f"""{ARTIFACTS}, {RANKED}, rest AS (SELECT scan_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, artifact_type
    FROM ranked WHERE r > 3)
  SELECT scan_id, dir, artifact_type, count(*) AS artifacts, CAST(sum(count(*)) OVER (PARTITION BY scan_id, dir) AS BIGINT) AS dir_total
  FROM rest GROUP BY scan_id, dir, artifact_type""")
def remainder(spark, sf):
    return R.remainder_by_directory(artifacts(spark, sf))


def _label_sql(column):
    key = f"string_split({column}, ' (+')[1]"
    prefixes = " ".join(f"WHEN starts_with({key}, {quote(p)}) THEN {quote(t)}" for p, t in L.REASON_PREFIX_LABELS)
    exact = " ".join(f"WHEN {key} = {quote(k)} THEN {quote(v)}" for k, v in L.REASON_LABELS.items())
    return f"CASE {exact} {prefixes} ELSE {column} END"


@query("reason_labels", f"""{ARTIFACTS}, x AS (SELECT unnest(risk_reasons) AS reason FROM artifacts)
  SELECT reason, {_label_sql('reason')} AS label, count(*) AS artifacts FROM x GROUP BY ALL""")
def reason_labels(spark, sf):
    from riskledger.functions.scoring import reason_label
    return (artifacts(spark, sf).select(F.explode("risk_reasons").alias("reason")).groupBy("reason")
            .agg(F.count("*").alias("artifacts")).withColumn("label", reason_label(F.col("reason"))))


@query("review_groups", f"""{ARTIFACTS}, m AS (SELECT scan_id, path, rule_order, CASE WHEN len(risk_reasons) = 0 THEN 'Other'
    ELSE {_label_sql('risk_reasons[1]')} END AS reason FROM artifacts WHERE verification_status = 'medium')
  SELECT scan_id, reason, count(*) AS artifacts, array_to_string(list(path ORDER BY path, rule_order)[1:2], '|') AS examples FROM m GROUP BY ALL""")
def review_groups(spark, sf):
    return R.review_groups(artifacts(spark, sf)).withColumn("examples", joined("examples"))


@query("lite_visible_split", f"""{ARTIFACTS}, {LITE} SELECT scan_id, path, artifact_type, CAST(r AS BIGINT) AS rank, local_score FROM lite WHERE r <= 3""")
def lite_split(spark, sf):
    return R.lite_visible(artifacts(spark, sf)).select(
        "scan_id", "path", "artifact_type", F.col("rank").cast("bigint").alias("rank"),
        F.col("local_score").cast("bigint").alias("local_score"))


@query("hidden_summary", f"""{ARTIFACTS}, {LITE}, h AS (SELECT * FROM lite WHERE r > 3)
  SELECT scan_id, 'by_type' AS dimension, artifact_type AS value, count(*) AS artifacts FROM h GROUP BY ALL
  UNION ALL SELECT scan_id, 'by_status', verification_status, count(*) FROM h GROUP BY ALL
  UNION ALL SELECT scan_id, 'by_origin', analysis_origin, count(*) FROM h GROUP BY ALL
  UNION ALL SELECT scan_id, 'count', '', count(*) FROM h GROUP BY ALL""")
def hidden(spark, sf):
    return R.hidden_summary(R.lite_hidden(artifacts(spark, sf)))
