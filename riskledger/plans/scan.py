"""The scan: corpus to scored, graded and classified artifacts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.catalog import names, weights as W
from riskledger.functions import identity as I, paths, scoring as S
from riskledger.functions.signals import computed_once
from riskledger.operators import detectors as D
from riskledger.operators.source_risk import source_surface
from riskledger.operators.rules import matches_any
from riskledger.session import cut
from riskledger.sources.rules import load_rules

PER_FILE = {"custom_rules": D.custom_rules, "mcp_configs": D.mcp_configs}
LIST_COLUMNS = ["declared_tools", "permissions", "dependencies", "api_endpoints", "server_names"]


def options(spark, user_rules: DataFrame | None = None, **kw) -> D.ScanOptions:
    return D.ScanOptions(rules=load_rules(spark, user_rules)[0], **kw)


def files_of_interest(files: DataFrame, ctx: D.ScanOptions) -> DataFrame:
    """The files whose name some per-file detector knows: usually a small share of a corpus."""
    name = paths.basename(F.col("path"))
    return files.where(matches_any(name, ctx.rules) | name.isin(names.CONTAINER_NAMES + names.MCP_NAMES))


def detect(files: DataFrame, ctx: D.ScanOptions, directories: DataFrame | None = None) -> DataFrame:
    """Artifacts of every detector that runs in the mode, united by column name.

    Contents are read twice: once to set the files of interest aside for the per-file detectors, once
    by the source scan; a detector of the user's own reads what it asks for.  Everything that looks
    across files reads paths only.
    """
    few = cut(files_of_interest(files, ctx))
    parts = []
    for name in D.detectors_for(ctx.mode):
        if name in PER_FILE:
            parts.append(PER_FILE[name](few, ctx))
        elif name == "containers":
            parts.append(D.containers(few, ctx, D.proximity_dirs(files)))
        elif name == "source_risks":
            parts.append(source_surface(files, ctx))
    if directories is not None and "browser_footprints" in D.detectors_for(ctx.mode):
        parts.append(D.browser_footprints(directories))
    for detector in ctx.detectors:
        if ctx.mode in detector.modes:
            parts.append(detector(files, ctx).withColumn("detector", F.lit(detector.name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for column in LIST_COLUMNS:
        out = out.withColumn(column, F.coalesce(F.col(column), F.array().cast("array<string>"))) \
            if column in out.columns else out.withColumn(column, F.array().cast("array<string>"))
    return out


def identify(artifacts: DataFrame) -> DataFrame:
    """Content digest, artifact hash and id (the id uses the scope before classification).

    File artifacts are known by their content; artifacts without one file bring their own digest.
    """
    digest = F.col("content_hash") if "content_hash" in artifacts.columns else F.lit(None).cast("string")
    if "content_digest" in artifacts.columns:
        digest = F.coalesce(digest, F.col("content_digest"))
    out = artifacts.withColumn("content_digest", digest)
    out = out.withColumn("artifact_hash", I.artifact_hash(F.col("content_digest"), F.col("artifact_type")))
    return out.withColumn("artifact_id", I.artifact_id(F.col("artifact_hash"), F.col("origin")))


def score(artifacts: DataFrame) -> DataFrame:
    out = computed_once(artifacts, _parts=S.contributions(F.col("signals"), F.col("declared_tools")))
    return computed_once(out, risk_score=S.risk_score(F.col("artifact_type"), F.col("_parts")),
                         risk_reasons=S.top_reasons(F.col("_parts"))).drop("_parts")


def grade(artifacts: DataFrame) -> DataFrame:
    governed = S.governed(F.col("declared_tools"), F.col("permissions"), F.col("api_endpoints"))
    return computed_once(artifacts, verification_status=S.verify(F.col("risk_score"), F.col("signals"), governed))


def classify(artifacts: DataFrame, mode: str) -> DataFrame:
    kind, signals = F.col("artifact_type"), F.col("signals")
    scope = S.artifact_scope(kind, F.col("path"), F.col("origin"), mode)
    out = computed_once(artifacts, artifact_scope=scope,
                        analysis_origin=S.analysis_origin(kind, signals, F.col("verification_status")))
    return computed_once(out, registry_eligible=S.registry_eligible(
        kind, F.col("artifact_scope"), signals, F.col("confidence")))


def scan(files: DataFrame, ctx: D.ScanOptions, directories: DataFrame | None = None) -> DataFrame:
    """Artifacts with identity, score, severity, scope and order of appearance."""
    found = identify(detect(files, ctx, directories))
    ranked = found.withColumn("detector_rank", S.lookup(names.DETECTOR_RANK, F.col("detector"), 99))
    return classify(grade(score(ranked)), ctx.mode)


def filter_by_severity(artifacts: DataFrame, level: str | Column) -> DataFrame:
    """Keeps by score, not by severity label, so a critical row of low score can drop out.

    ``level`` is one level for all rows, or a column that names each row's own.
    """
    least = F.lit(S.min_score_of(level)) if isinstance(level, str) else S.lookup(dict(W.SEVERITY_BANDS), level, 0)
    return artifacts.where(F.col("risk_score") >= least)


def registry_identity(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(
        "artifact_hash", F.col("artifact_type").alias("artifact_kind"),
        F.coalesce("path", F.lit("unknown")).alias("artifact_locator"), "artifact_scope",
        "registry_eligible", F.lit("v1").alias("schema_version"))
