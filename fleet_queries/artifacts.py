"""Rules, detectors, scoring and classification over the derived files."""

from pyspark.sql import functions as F

from fleet_queries import artifact_sql as A, sqltext as S
from fleet_queries.corpus import FILES_SQL, files
from fleet_queries.registry import query, quote
from riskledger.catalog import names as N, patterns as P
from riskledger.functions import scoring as SC
from riskledger.operators import detectors as D, source_risk as R
from riskledger.operators.corpus import with_path_parts
from riskledger.plans import scan as plan

_PLANS = {}


def _memo(kind, spark, sf, build):
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def options(spark):
    return _memo("options", spark, "", lambda: plan.options(spark))


def artifacts(spark, sf):
    return _memo("artifacts", spark, sf, lambda: plan.scan(files(spark, sf), options(spark)))


def detected(spark, sf):
    return _memo("detected", spark, sf, lambda: plan.detect(files(spark, sf), options(spark)))


def joined(c):
    return F.array_join(c, "|")


ARTIFACTS = A.ARTIFACTS


@query("rule_match", f"{A.DETECTED} SELECT f.path, r.rule_name, CAST(r.rule_order AS BIGINT) AS rule_order "
                     "FROM custom r JOIN files f USING (file_id)")
def rule_match(spark, sf):
    from riskledger.operators import rules as RO
    rules = options(spark).rules
    df = with_path_parts(files(spark, sf)).select("path", "name")
    return RO.match_rules(df, rules).select(
        "path", "rule_name", (F.col("match_kind") * 100000 + F.col("rule_rank")).cast("bigint").alias("rule_order"))


@query("rule_apply", f"""{A.DETECTED} SELECT f.path, r.rule_name, r.artifact_type,
  CAST(r.confidence AS DOUBLE) AS confidence, {S.joined('r.signals')} AS signals
  FROM custom r JOIN files f USING (file_id)""")
def rule_apply(spark, sf):
    return D.custom_rules(files(spark, sf), options(spark)).select(
        "path", "rule_name", "artifact_type", "confidence", joined("signals").alias("signals"))


@query("mcp_config_detect", f"""{A.DETECTED} SELECT f.path, CAST(m.confidence AS DOUBLE) AS confidence,
  {S.joined('m.signals')} AS signals, {S.joined('s.ex')} AS execution_tokens, {S.joined('s.sh')} AS shell_tokens,
  {S.joined('s.endpoints')} AS endpoints, CAST(len(s.servers) AS BIGINT) AS server_count,
  {S.joined('s.servers')} AS server_names FROM mcp m JOIN files f USING (file_id) JOIN served s USING (file_id)""")
def mcp_detect(spark, sf):
    return D.mcp_configs(files(spark, sf), options(spark)).select(
        "path", "confidence", joined("signals").alias("signals"),
        joined("execution_tokens").alias("execution_tokens"), joined("shell_tokens").alias("shell_tokens"),
        joined("api_endpoints").alias("endpoints"), F.col("server_count").cast("bigint").alias("server_count"),
        joined("server_names").alias("server_names"))


@query("container_detect", f"""{A.DETECTED} SELECT f.path, b.artifact_type, CAST(b.confidence AS DOUBLE) AS confidence,
  {S.joined('b.signals')} AS signals, x.ai_near AS near, x.agentic FROM box b JOIN files f USING (file_id) JOIN boxed x USING (file_id)""")
def container_detect(spark, sf):
    return D.containers(files(spark, sf), options(spark)).select(
        "path", "artifact_type", "confidence", joined("signals").alias("signals"),
        F.col("ai_artifact_proximity").alias("near"), F.col("direct_agentic_evidence").alias("agentic"))


@query("sibling_proximity", f"""WITH {FILES_SQL} SELECT c.path FROM files c
  WHERE c.name IN ({', '.join(quote(n) for n in N.CONTAINER_NAMES)}) AND EXISTS (SELECT 1 FROM files s
    WHERE s.scan_id = c.scan_id AND s.dir = c.dir AND s.name IN ({', '.join(quote(n) for n in N.PROXIMITY_NAMES)}))""")
def sibling(spark, sf):
    df = files(spark, sf)
    boxes = with_path_parts(df).where(F.col("name").isin(N.CONTAINER_NAMES))
    return boxes.join(D.proximity_dirs(df), ["scan_id", "dir"], "left_semi").select("path")


@query("container_fields", f"""WITH {FILES_SQL},
  d AS (SELECT path, content, name, string_split(content, chr(10)) AS ls FROM files
    WHERE name IN ({', '.join(quote(n) for n in N.CONTAINER_NAMES)})),
  l AS (SELECT path, name, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d),
  ports AS (SELECT path, n, unnest(string_split_regex(trim(substr(trim(line), 8)), '\\s+')) AS tok FROM l
    WHERE starts_with(upper(trim(line)), 'EXPOSE ') AND name = 'Dockerfile'),
  port AS (SELECT path, string_agg(string_split(tok, '/')[1], '|' ORDER BY n) AS exposed_ports FROM ports
    WHERE regexp_full_match(string_split(tok, '/')[1], '[0-9]*') GROUP BY path),
  keyed AS (SELECT path, line, n, last_value(CASE WHEN line <> '' AND NOT starts_with(line, ' ') AND NOT starts_with(line, '#')
      THEN line END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS top, length(line) - length(ltrim(line)) AS depth
    FROM l WHERE name <> 'Dockerfile' AND trim(line) <> '' AND NOT starts_with(trim(line), '#')),
  below AS (SELECT *, min_by(depth, n) OVER (PARTITION BY path) AS level FROM keyed
    WHERE starts_with(top, 'services:') AND depth > 0 AND line LIKE '%:'),
  svc AS (SELECT path, string_agg(left(trim(line), length(trim(line)) - 1), '|' ORDER BY n) AS services FROM below
    WHERE depth = level GROUP BY path)
  SELECT d.path, CASE WHEN contains(name, 'compose') THEN 'service_orchestration' ELSE 'image_definition' END AS kind,
    CASE WHEN name = 'Dockerfile' THEN regexp_extract(content, 'FROM (\\S+)', 1) END AS base_image,
    exposed_ports, services FROM d LEFT JOIN port USING (path) LEFT JOIN svc USING (path)""")
def container_fields(spark, sf):
    return D.containers(files(spark, sf), options(spark)).select(
        "path", F.col("container_kind").alias("kind"), "base_image",
        joined("exposed_ports").alias("exposed_ports"), joined("services").alias("services"))


@query("source_and_json_findings", f"{A.FINDINGS} SELECT * FROM findings")
def findings(spark, sf):
    return R.findings(files(spark, sf), options(spark)).withColumn("line", F.col("line").cast("bigint"))


@query("json_config_findings", f"{A.FINDINGS} SELECT signal, family, count(*) AS files, CAST(max(line) AS BIGINT) AS last_line "
                               "FROM findings WHERE path LIKE '%.json' GROUP BY ALL")
def json_findings(spark, sf):
    return (R.json_findings(files(spark, sf), options(spark)).groupBy("signal", "family")
            .agg(F.count("*").alias("files"), F.max("line").cast("bigint").alias("last_line")))


@query("identity_file_findings", f"{A.FINDINGS} SELECT path, signal, line, summary FROM findings WHERE family = 'cognitive_file'")
def identity_findings(spark, sf):
    return (R.source_findings(files(spark, sf), options(spark)).where("family = 'cognitive_file'")
            .select("path", "signal", F.col("line").cast("bigint").alias("line"), "summary"))


CALLS = P.SOURCE_CALL_PATTERNS


@query("nonliteral_calls", f"""WITH {FILES_SQL}, l AS (SELECT file_id, unnest(string_split_regex(content, '\\r?\\n')) AS line FROM files)
  SELECT file_id, {', '.join(f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS {sig.split(':')[1]}" for _, sig, _, _, cond in A._line_rules()[:3])}
  FROM l GROUP BY file_id""")
def nonliteral(spark, sf):
    lined = files(spark, sf).select("file_id", F.explode(F.split("content", r"\r?\n")).alias("line"))
    return lined.groupBy("file_id").agg(*[
        F.count_if(R.nonliteral_argument(F.col("line"), expr, starts)).alias(signal.split(":")[1])
        for signal, _, expr, starts in CALLS])


@query("source_surface", f"""{A.FINDINGS}, fam AS (SELECT scan_id, family, count(*) AS n FROM findings GROUP BY ALL),
  risky AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, path) AS r FROM
    (SELECT scan_id, path, count(*) AS n FROM findings GROUP BY ALL)),
  counts AS (SELECT scan_id, CAST(count(*) FILTER (WHERE is_source) AS BIGINT) AS source_files,
    CAST(count(*) FILTER (WHERE NOT is_source) AS BIGINT) AS json_files FROM src_files GROUP BY scan_id)
  SELECT c.scan_id, '/home/u' || right(c.scan_id, 1) AS root, source_files, json_files, 0.65::DOUBLE AS confidence,
    (SELECT string_agg(DISTINCT signal, '|' ORDER BY signal) FROM findings f WHERE f.scan_id = c.scan_id) AS signals,
    (SELECT string_agg(family || '=' || n, '|' ORDER BY family) FROM fam f WHERE f.scan_id = c.scan_id) AS family_counts,
    (SELECT string_agg(path, '|' ORDER BY r) FROM risky f WHERE f.scan_id = c.scan_id AND r <= 5) AS top_files
  FROM counts c""")
def surface(spark, sf):
    df = R.source_surface(files(spark, sf), options(spark))
    fams = F.transform(F.map_entries("finding_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.select("scan_id", F.col("path").alias("root"), F.col("scanned_source_file_count").alias("source_files"),
                     F.col("scanned_json_file_count").alias("json_files"), "confidence",
                     joined("signals").alias("signals"), joined(F.array_sort(fams)).alias("family_counts"),
                     joined("top_risky_files").alias("top_files"))


@query("top_risky_files", f"""{A.FINDINGS} SELECT scan_id, path, findings, CAST(rank AS BIGINT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY findings DESC, path) AS rank FROM (
      SELECT scan_id, path, count(*) AS findings FROM findings GROUP BY ALL)) WHERE rank <= 5""")
def top_risky(spark, sf):
    return R.top_risky_files(R.findings(files(spark, sf), options(spark))).withColumn("rank", F.col("rank").cast("bigint"))


@query("common_root", f"""WITH {FILES_SQL}, p AS (SELECT scan_id, min(path) AS lo, max(path) AS hi FROM files GROUP BY scan_id)
  SELECT scan_id, '/home/u' || right(scan_id, 1) AS root FROM p""")
def common_root(spark, sf):
    return (files(spark, sf).groupBy("scan_id").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
            .select("scan_id", R.common_root(F.col("lo"), F.col("hi")).alias("root")))


@query("detector_union", f"{A.DETECTED} SELECT detector, artifact_type, count(*) AS artifacts FROM detected GROUP BY ALL")
def detector_union(spark, sf):
    return detected(spark, sf).groupBy("detector", "artifact_type").agg(F.count("*").alias("artifacts"))


SURFACE_HASHES = f"""fam AS (SELECT scan_id, family, count(*) AS n FROM findings GROUP BY ALL),
  risky AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, path) AS r FROM (SELECT scan_id, path, count(*) AS n FROM findings GROUP BY ALL)),
  counts AS (SELECT scan_id, count(*) FILTER (WHERE is_source) AS source_files, count(*) FILTER (WHERE NOT is_source) AS json_files FROM src_files GROUP BY scan_id),
  facts AS (SELECT scan_id, '{{"metadata":{{"ai_adjacent_context":true,"finding_counts":['
      || (SELECT string_agg('{{"key":"' || family || '","value":' || n || '}}', ',' ORDER BY family) FROM fam f WHERE f.scan_id = c.scan_id)
      || '],"matched_families":[' || (SELECT string_agg('"' || family || '"', ',' ORDER BY family) FROM fam f WHERE f.scan_id = c.scan_id)
      || '],"scanned_json_file_count":' || json_files || ',"scanned_source_file_count":' || source_files || ',"top_risky_files":['
      || (SELECT string_agg('"' || path || '"', ',' ORDER BY r) FROM risky k WHERE k.scan_id = c.scan_id AND r <= 5) || ']}},"risk_reasons":[],"signals":['
      || (SELECT string_agg(DISTINCT '"' || signal || '"', ',' ORDER BY '"' || signal || '"') FROM findings f WHERE f.scan_id = c.scan_id) || ']}}' AS text FROM counts c),
  surfaces AS (SELECT scan_id, sha256(text) AS content_digest,
    sha256('{{"artifact_content":"' || sha256(text) || '","artifact_type":"source_risk_surface","version":"v1"}}') AS artifact_hash FROM facts)"""
KNOWN = f"""{ARTIFACTS}, {SURFACE_HASHES}, known AS (SELECT a.* REPLACE (coalesce(a.artifact_hash, s.artifact_hash) AS artifact_hash)
  FROM artifacts a LEFT JOIN surfaces s ON a.file_id IS NULL AND s.scan_id = a.scan_id)"""


@query("surface_digests", f"{A.FINDINGS}, {SURFACE_HASHES} SELECT scan_id, content_digest, artifact_hash FROM surfaces")
def surface_digests(spark, sf):
    found = plan.identify(R.source_surface(files(spark, sf), options(spark)))
    return found.select("scan_id", "content_digest", "artifact_hash")


@query("user_detector", f"""WITH {FILES_SQL} SELECT path, 'readme' AS artifact_type, 'readmes' AS detector,
  CAST(CASE WHEN contains(content, 'the') THEN 3 ELSE 0 END AS BIGINT) AS base FROM files WHERE name = 'README.md'""")
def user_detector(spark, sf):
    from dataclasses import replace

    class Readmes:
        """A detector of a user's own, added through the options."""

        name, modes = "readmes", ["workdir"]

        def __call__(self, corpus, ctx):
            found = D.prepare(corpus, ctx).where("name = 'README.md'")
            return found.select("scan_id", "path", "name", "dir", "origin", F.lit("readme").alias("artifact_type"), F.lit(0.5).alias("confidence"),
                                F.lit(0).alias("rule_order"), F.when(F.contains("text", F.lit("the")), 3).otherwise(0).alias("base"),
                                F.array().cast("array<string>").alias("signals"))
    found = plan.detect(files(spark, sf), replace(options(spark), detectors=(Readmes(),)))
    return found.where("detector = 'readmes'").select("path", "artifact_type", "detector", F.col("base").cast("bigint").alias("base"))


@query("risk_score_and_reasons", f"{ARTIFACTS} SELECT path, artifact_type, coalesce(rule_name, '') AS rule_name, "
                                 f"risk_score, {S.joined('risk_reasons')} AS reasons FROM artifacts")
def risk(spark, sf):
    return plan.score(detected(spark, sf)).select(
        "path", "artifact_type", F.coalesce("rule_name", F.lit("")).alias("rule_name"),
        F.col("risk_score").cast("bigint").alias("risk_score"), joined("risk_reasons").alias("reasons"))


@query("secret_suppression", f"""{ARTIFACTS} SELECT artifact_type, count(*) AS artifacts, CAST(sum(risk_score) AS BIGINT) AS score
  FROM artifacts WHERE list_contains(signals, 'credential_exposure_signal') GROUP BY ALL""")
def suppression(spark, sf):
    df = plan.score(detected(spark, sf).where(F.array_contains("signals", "credential_exposure_signal")))
    return df.groupBy("artifact_type").agg(F.count("*").alias("artifacts"), F.sum("risk_score").alias("score"))


@query("declared_discount", f"""{ARTIFACTS} SELECT path, risk_score FROM artifacts
  WHERE len(declared_tools) > 0""")
def discount(spark, sf):
    df = detected(spark, sf).where("size(declared_tools) > 0")
    return plan.score(df).select("path", F.col("risk_score").cast("bigint").alias("risk_score"))


@query("severity_verify", f"""{ARTIFACTS} SELECT artifact_type, verification_status, governed, count(*) AS artifacts
  FROM artifacts GROUP BY ALL""")
def severity(spark, sf):
    governed = SC.governed(F.col("declared_tools"), F.col("api_endpoints"))
    return (artifacts(spark, sf).groupBy("artifact_type", "verification_status", governed.alias("governed"))
            .agg(F.count("*").alias("artifacts")))


@query("scope_eligibility_origin", f"""{ARTIFACTS} SELECT path, coalesce(rule_name, detector) AS rule, artifact_scope,
  registry_eligible, analysis_origin FROM artifacts""")
def scope(spark, sf):
    return artifacts(spark, sf).select("path", F.coalesce("rule_name", "detector").alias("rule"), "artifact_scope",
                                       "registry_eligible", "analysis_origin")


@query("capability_derive", f"""{ARTIFACTS}, c AS (SELECT artifact_type, unnest(caps) AS capability FROM artifacts)
  SELECT artifact_type, capability, {A.lookup(A.L.CAPABILITY_LEVEL, 'capability', "'info'")} AS level,
    {A.lookup(A.L.CAPABILITY_LABEL, 'capability', "replace(capability, '_', ' ')")} AS label, count(*) AS artifacts FROM c GROUP BY ALL""")
def capability(spark, sf):
    df = detected(spark, sf).select("artifact_type", F.explode(SC.capabilities(F.col("signals"))).alias("capability"))
    c = F.col("capability")
    return (df.groupBy("artifact_type", "capability").agg(F.count("*").alias("artifacts"))
            .withColumns({"level": SC.capability_level(c), "label": SC.capability_label(c)}))


@query("local_policy_score", f"{ARTIFACTS} SELECT path, artifact_type, coalesce(rule_name, '') AS rule_name, local_score FROM artifacts")
def local_score(spark, sf):
    return detected(spark, sf).select(
        "path", "artifact_type", F.coalesce("rule_name", F.lit("")).alias("rule_name"),
        SC.local_policy_score(F.col("artifact_type"), F.col("signals")).cast("bigint").alias("local_score"))


@query("severity_label", f"""{ARTIFACTS} SELECT upper(['info', 'low', 'medium', 'high', 'critical'][band]) AS label,
  CAST(band AS BIGINT) AS label_rank, count(*) AS artifacts FROM artifacts GROUP BY ALL""")
def label(spark, sf):
    df = plan.score(detected(spark, sf)).withColumn("label", SC.severity_label(F.col("risk_score")))
    return (df.groupBy("label").agg(F.count("*").alias("artifacts"))
            .withColumn("label_rank", SC.severity_rank(F.lower("label")).cast("bigint")))


@query("artifact_identity", f"""{KNOWN} SELECT path, artifact_type, artifact_hash,
  sha256('{{"artifact_hash":"' || artifact_hash || '","artifact_scope":"' || origin || '"}}') AS artifact_id,
  path || ':' || left(artifact_hash, 12) AS entity_id, left(sha256(path), 12) AS short_hash
  FROM known""")
def identity(spark, sf):
    from riskledger.functions import identity as I
    df = plan.identify(detected(spark, sf))
    return df.select("path", "artifact_type", "artifact_hash", "artifact_id",
                     I.entity_id(F.col("path"), F.col("artifact_hash")).alias("entity_id"),
                     I.short_hash(F.col("path")).alias("short_hash"))


@query("registry_identity", f"""{KNOWN} SELECT artifact_hash, artifact_type AS artifact_kind, path AS artifact_locator,
  artifact_scope, registry_eligible, 'v1' AS schema_version FROM known""")
def registry_identity(spark, sf):
    return plan.registry_identity(artifacts(spark, sf))


@query("posture_by_scan", f"""{ARTIFACTS} SELECT scan_id, artifact_type,
  CAST(count(*) FILTER (WHERE verification_status IN ('critical', 'high')) AS BIGINT) AS flagged,
  CAST(count(*) FILTER (WHERE verification_status = 'medium') AS BIGINT) AS review,
  CAST(count(*) FILTER (WHERE verification_status IN ('low', 'info')) AS BIGINT) AS clear,
  CAST(max(risk_score) AS BIGINT) AS worst_score FROM artifacts GROUP BY ALL""")
def posture_by_scan(spark, sf):
    status = F.col("verification_status")
    return artifacts(spark, sf).groupBy("scan_id", "artifact_type").agg(
        F.count_if(status.isin("critical", "high")).alias("flagged"),
        F.count_if(status == "medium").alias("review"),
        F.count_if(status.isin("low", "info")).alias("clear"),
        F.max("risk_score").cast("bigint").alias("worst_score"))
