"""Incremental re-scan, stored tables and log evidence over the derived files."""

import uuid

from pyspark.sql import functions as F

from fleet_queries import artifact_sql as A, sqltext as S
from fleet_queries.artifacts import joined, options
from fleet_queries.corpus import FILES_SQL, files, files_of
from fleet_queries.registry import query, quote, table
from riskledger.catalog import names as N, patterns as P
from riskledger.functions import paths
from riskledger.operators import detectors as D, digests as DG, incremental as C
from riskledger.streaming import logs as LG, rescan as RS

VERSION, PROFILE = "1", "p"


def two_scans(spark, sf):
    """The corpus, and a second scan of its first half that has the same paths and contents."""
    f = files(spark, sf)
    return f.unionByName(f.where("file_id % 2 = 0").withColumn("scan_id", F.lit("twin")))


TWINS_SQL = f"{FILES_SQL}, both_scans AS (SELECT * FROM files UNION ALL SELECT * REPLACE ('twin' AS scan_id) FROM files WHERE file_id % 2 = 0)"
OLD = "file_id % 11 <> 0 AND NOT (scan_id = 'twin' AND file_id % 3 = 0)"


def stored_state(spark, sf):
    """State keys of an earlier run: of every file but the new ones, some since edited in place."""
    old = C.with_state_key(two_scans(spark, sf))
    edited = F.col("file_id") % 5 == 0
    return (old.where(OLD).withColumn("state_key", F.when(
        edited, F.sha2(F.concat("state_key", F.lit("old")), 256)).otherwise(F.col("state_key"))))


def stored_bundles(spark, sf):
    """Bundles of the earlier run: rows of the rule detector, marked by an older confidence."""
    state = stored_state(spark, sf)
    found = D.custom_rules(state.drop("state_key"), options(spark)).withColumn("confidence", F.lit(0.123))
    return C.bundle_rows(found, state, PROFILE, "custom_rules", VERSION)


HIT = f"{OLD} AND file_id % 5 <> 0"


@query("rescan_hit_miss_split", f"WITH {TWINS_SQL} SELECT CASE WHEN {HIT} THEN 'hit' ELSE 'miss' END AS state, scan_id, path FROM both_scans")
def hit_miss(spark, sf):
    now = C.with_state_key(two_scans(spark, sf))
    hits, misses = C.split_hits(now, stored_bundles(spark, sf), PROFILE, "custom_rules",
                                C.detector_fingerprint("custom_rules", VERSION))
    return (hits.select(F.lit("hit").alias("state"), "scan_id", "path").distinct()
            .unionAll(misses.select(F.lit("miss").alias("state"), "scan_id", "path")))


TWIN_RULES_SQL = f"""{A.DETECTED}, both_scans AS (SELECT file_id, scan_id, path, origin FROM files
    UNION ALL SELECT file_id, 'twin', path, origin FROM files WHERE file_id % 2 = 0)"""


@query("rescan_reused_and_fresh", f"""{TWIN_RULES_SQL} SELECT f.scan_id, f.path, c.rule_name, CASE WHEN {HIT} THEN 0.123 ELSE CAST(c.confidence AS DOUBLE) END AS confidence,
  {S.joined('c.signals')} AS signals FROM custom c JOIN both_scans f USING (file_id)""")
def rescan(spark, sf):
    now = C.with_state_key(two_scans(spark, sf))
    rows, _, _ = C.reuse(now, stored_bundles(spark, sf), PROFILE, "custom_rules", VERSION, "workdir",
                         lambda part: D.custom_rules(part, options(spark)))
    return rows.select("scan_id", "path", "rule_name", "confidence", joined("signals").alias("signals"))


@query("rescan_unattributed", f"WITH {TWINS_SQL} SELECT scan_id, path FROM both_scans WHERE file_id % 13 = 0 AND {HIT}")
def unattributed(spark, sf):
    now = C.with_state_key(two_scans(spark, sf))
    _, misses = C.split_hits(now, stored_bundles(spark, sf), PROFILE, "custom_rules",
                             C.detector_fingerprint("custom_rules", VERSION))
    claimed = now.where("file_id % 13 = 0").select("scan_id", "path")
    return C.unattributed(claimed, misses)


BUNDLE_ROWS_SQL = """(SELECT file_id FROM custom UNION ALL SELECT f.file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM custom c WHERE c.file_id = f.file_id)) b"""
GONE = "scan_id = 'scan1' AND file_id % 3 = 0"


@query("prune_deleted", f"""{TWIN_RULES_SQL} SELECT f.scan_id, f.path, count(*) AS bundles FROM {BUNDLE_ROWS_SQL}
  JOIN both_scans f USING (file_id) WHERE {OLD} AND NOT ({GONE}) GROUP BY ALL""")
def prune(spark, sf):
    left = two_scans(spark, sf).where(f"NOT ({GONE})")
    kept = C.prune(stored_bundles(spark, sf), left, "/home/u1", PROFILE)
    return kept.groupBy("scan_id", "path").agg(F.count("*").alias("bundles"))


@query("store_round_trip", f"""{TWIN_RULES_SQL}, kept AS (SELECT f.scan_id, f.path, count(*) AS bundles FROM {BUNDLE_ROWS_SQL} JOIN both_scans f USING (file_id)
    WHERE {OLD} GROUP BY ALL)
  SELECT 'written' AS step, scan_id, path, bundles FROM kept UNION ALL SELECT 'pruned', scan_id, path, bundles FROM kept WHERE scan_id <> 'scan1'""")
def store_round_trip(spark, sf):
    """Write a profile, refresh a scan of which nothing is left, write back, read."""
    folder = _folder(spark)
    rows = stored_bundles(spark, sf).select("profile_key", "scan_id", "detector", "path", "state_key", "fingerprint", "empty")
    C.write_store(rows, f"{folder}/old", PROFILE)
    stored = C.read_store(spark, f"{folder}/old", rows.schema)
    left = two_scans(spark, sf).where("scan_id <> 'scan1'")
    pruned = C.prune(stored, left, "/home/u1", PROFILE, spark.createDataFrame([("scan1",)], "scan_id string"))
    touched = C.buckets_of(stored.where("scan_id = 'scan1'"))
    C.write_store(pruned, f"{folder}/old", PROFILE, touched)
    again = C.read_store(spark, f"{folder}/old", rows.schema)
    counted = lambda df, step: df.groupBy("scan_id", "path").agg(F.count("*").alias("bundles")).withColumn("step", F.lit(step))
    return counted(stored, "written").unionByName(counted(again, "pruned"))


@query("stored_candidates_by_root", f"""{TWIN_RULES_SQL} SELECT DISTINCT f.scan_id, f.path, f.origin FROM custom c JOIN both_scans f USING (file_id)
  WHERE {OLD} AND starts_with(f.path, '/home/u2/')""")
def stored_candidates(spark, sf):
    states = stored_state(spark, sf).select("scan_id", "path", "origin", "state_key")
    return C.stored_candidates(stored_bundles(spark, sf), states, "/home/u2", PROFILE).select("scan_id", "path", "origin")


def _rules_digest():
    """The digest of the built-in rules as this module spells them, not as the library does."""
    import hashlib
    import json

    from riskledger.catalog.rules import BUILTIN_RULES
    block = lambda b: b and {"terms": b["keywords"], "signals_prefix": b["signals_prefix"],
                             "boost_confidence": b["boost_confidence"], "boost_threshold": b["boost_threshold"]}
    rows = [{"rule_rank": i, "source": "builtin", **r["detector"], **r["match"], **{
        name: block(r.get(name)) for name in ("keywords", "deep_keywords", "patterns", "deep_patterns")}} for i, r in enumerate(BUILTIN_RULES)]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@query("profile_and_fingerprints", f"""WITH {FILES_SQL}, r AS (SELECT DISTINCT root FROM files)
  SELECT root, sha256('1:1:workdir:true:' || root || ':custom_rules,containers:{_rules_digest()}') AS profile_key,
    sha256('1:custom_rules') AS detector_fingerprint FROM r""")
def fingerprints(spark, sf):
    roots = files(spark, sf).select("root").distinct()
    rules = F.lit(C.rules_fingerprint(options(spark).rules))
    return roots.select("root", C.profile_key(F.lit("workdir"), F.lit(True), F.col("root"), F.lit("custom_rules,containers"),
                                              rules, VERSION).alias("profile_key"),
                        C.detector_fingerprint("custom_rules", VERSION).alias("detector_fingerprint"))


def _bag_sql(rows, item, name):
    """Digest of a bag of texts under (scan_id, dir), in shares of shares, as CTEs that end in ``name``."""
    step = lambda source, digits, more: (f"SELECT scan_id, dir, left(share, {digits}) AS share, sha256(string_agg(digest, chr(10) ORDER BY share, digest)) AS digest, "  # noqa: E731
                                         f"sum(items) AS items FROM {source} GROUP BY scan_id, dir, left(share, {digits}){more}")
    return (f"{name}0 AS (SELECT scan_id, dir, sha256({item}) AS digest, sha256({item}) AS share, 1 AS items FROM {rows}), "
            f"{name}4 AS ({step(name + '0', 4, '')}), {name}2 AS ({step(name + '4', 2, '')}), {name} AS ({step(name + '2', 0, '')})")


def _digests_sql(name, states):
    """``name``: own and tree digests of the directories of a state table."""
    return (f"{name}_files AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({states})), "
            + _bag_sql(f"{name}_files", "path || chr(10) || state_key", f"{name}_own") + ", "
            + f"""{name}_up AS (SELECT scan_id, dir || chr(10) || digest AS line, items, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1),
                lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS dir FROM {name}_own), """
            + _bag_sql(f"{name}_up", "line", f"{name}_tree") + ", "
            + f"""{name} AS (SELECT t.scan_id, t.dir, o.digest AS own, CAST(coalesce(o.items, 0) AS BIGINT) AS files, t.digest AS tree,
                (SELECT CAST(sum(u.items) AS BIGINT) FROM {name}_up u WHERE u.scan_id = t.scan_id AND u.dir = t.dir) AS tree_files
              FROM {name}_tree t LEFT JOIN {name}_own o ON o.scan_id = t.scan_id AND o.dir = t.dir)""")


_KEY_SQL = """sha256(path || ':' || origin || '::' || size_bytes || ':' || epoch_ns(modified_at) || ':' || sha256(content))"""
_NOW_SQL = f"SELECT scan_id, path, {_KEY_SQL} AS state_key FROM both_scans"
#: In the earlier state projects of an odd number are as they are now, but for those whose number 9 divides, which are gone since.
_EARLIER = "file_id // 16 % 2 = 1"
_EARLIER_SQL = f"""SELECT scan_id, CASE WHEN file_id // 16 % 9 = 0 THEN path || '.old' ELSE path END AS path,
    CASE WHEN {_EARLIER} OR file_id % 5 <> 0 THEN state_key ELSE sha256(state_key || 'old') END AS state_key
  FROM (SELECT *, {_KEY_SQL} AS state_key FROM both_scans) WHERE {_EARLIER} OR file_id % 11 <> 0"""


def earlier_states(spark, sf):
    """State keys of an earlier run: files of every second project differ, are missing, or have other names."""
    now = C.with_state_key(two_scans(spark, sf)).select("file_id", "scan_id", "path", "state_key")
    steady = F.expr(_EARLIER.replace("//", "div"))
    renamed = F.expr("file_id div 16 % 9 = 0")
    return now.where(steady | (F.col("file_id") % 11 != 0)).select(
        "scan_id", F.when(renamed, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"),
        F.when(steady | (F.col("file_id") % 5 != 0), F.col("state_key")).otherwise(F.sha2(F.concat("state_key", F.lit("old")), 256)).alias("state_key"))


def both_states(spark, sf):
    """The two state tables, stored as a run leaves them for the next one."""
    folder = _folder(spark)
    now = C.with_state_key(two_scans(spark, sf)).select("scan_id", "path", "state_key")
    for name, rows in (("earlier", earlier_states(spark, sf)), ("now", now)):
        rows.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/earlier"), spark.read.parquet(f"{folder}/now")


_COMPARED_SQL = f"""WITH {TWINS_SQL}, {_digests_sql('old_d', _EARLIER_SQL)}, {_digests_sql('new_d', _NOW_SQL)},
  compared AS (SELECT scan_id, dir, CASE WHEN o.tree IS NULL THEN 'new' WHEN n.tree IS NULL THEN 'gone' WHEN o.tree <> n.tree THEN 'changed' ELSE 'same' END AS state,
    o.own IS DISTINCT FROM n.own AS own_differs FROM old_d o FULL JOIN new_d n USING (scan_id, dir))"""


@query("directory_digests", f"WITH {TWINS_SQL}, {_digests_sql('d', _NOW_SQL)} SELECT * FROM d")
def directory_digests(spark, sf):
    return DG.directory_digests(C.with_state_key(two_scans(spark, sf)))


def _compared(old, new):
    return DG.compare_directories(DG.directory_digests(old), DG.directory_digests(new))


@query("directories_compared", f"""{_COMPARED_SQL} SELECT *, state = 'same' AND NOT EXISTS (SELECT 1 FROM compared u WHERE u.state = 'same'
    AND u.scan_id = c.scan_id AND c.dir <> '' AND u.dir = regexp_extract(c.dir, '^(.*)/[^/]*$', 1)) AS unchanged_root FROM compared c""")
def directories_compared(spark, sf):
    compared = _compared(*both_states(spark, sf))
    roots = DG.unchanged_roots(compared).withColumn("root", F.lit(True))
    return compared.join(roots, ["scan_id", "dir"], "left").withColumn("unchanged_root", F.coalesce("root", F.lit(False))).drop("root")


@query("files_of_changed_directories", f"""WITH {TWINS_SQL}, o AS ({_EARLIER_SQL}), n AS ({_NOW_SQL})
  SELECT * FROM (SELECT scan_id, path, CASE WHEN o.state_key IS NULL THEN 'new' WHEN n.state_key IS NULL THEN 'gone'
    WHEN o.state_key <> n.state_key THEN 'changed' END AS state FROM o FULL JOIN n USING (scan_id, path)) WHERE state IS NOT NULL""")
def files_of_changed_directories(spark, sf):
    """The SQL compares all files one by one; here only directories that differ are looked into."""
    old, new = both_states(spark, sf)
    return DG.changed_files(old, new, _compared(old, new))


# --- files on disk ------------------------------------------------------------------------------

def _on_disk(spark, sf, projects):
    """Files of so many projects one after the other in one file on disk, ``bundle=<number>/...``."""
    folder = _folder(spark)
    rows = files(spark, sf).select(F.expr(f"file_id div {16 * projects}").alias("bundle"), "file_id", "content")
    (rows.repartition("bundle").sortWithinPartitions("bundle", "file_id").select("bundle", F.col("content").alias("value"))
     .write.partitionBy("bundle").text(folder))
    return folder


def _bundle(path):
    return F.regexp_extract(path, "bundle=([0-9]+)/", 1).cast("bigint")


def _bundles_sql(projects):
    return f"""bundles AS (SELECT file_id // {16 * projects} AS bundle, string_agg(content, chr(10) ORDER BY file_id) || chr(10) AS content
    FROM files GROUP BY ALL)"""


@query("files_on_disk", f"""WITH {FILES_SQL}, {_bundles_sql(1)} SELECT CAST(bundle AS BIGINT) AS bundle, CAST(strlen(content) AS BIGINT) AS size_bytes,
  sha256(content) AS content_hash FROM bundles""")
def files_on_disk(spark, sf):
    from riskledger.sources.files import read_files
    read = read_files(spark, _on_disk(spark, sf, 1), "disk", name_glob="*.txt")
    return read.select(_bundle(F.col("path")).alias("bundle"), "size_bytes", F.sha2("content", 256).alias("content_hash"))


RANGE_BYTES = 1 << 20
_LINE_SQL = A.FINDINGS_SQL[A.FINDINGS_SQL.index("src_lines AS"):A.FINDINGS_SQL.index("findings AS (")].rstrip().rstrip(",")


@query("large_file_findings", f"""WITH {FILES_SQL}, {_bundles_sql(64)}, src_files AS (
    SELECT bundle AS file_id, 'disk' AS scan_id, CAST(bundle AS BIGINT) AS path, content, TRUE AS is_source FROM bundles),
  {_LINE_SQL} SELECT path AS bundle, signal, m.family AS family, CAST(m.line AS BIGINT) AS line, m.summary AS summary FROM src_first""")
def large_file_findings(spark, sf):
    """Large files in ranges of a megabyte; the SQL reads each of them whole."""
    from riskledger.operators.source_risk import findings_in_lines
    from riskledger.sources.files import read_lines
    folder, setting = _folder(spark), "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    root = _on_disk(spark, sf, 64)
    spark.conf.set(setting, str(RANGE_BYTES))
    try:
        findings_in_lines(read_lines(spark, root, "disk")).write.parquet(folder)
    finally:
        spark.conf.set(setting, usual)
    return spark.read.parquet(folder).select(_bundle(F.col("path")).alias("bundle"), "signal", "family",
                                             F.col("line").cast("bigint").alias("line"), "summary")


# --- logs -------------------------------------------------------------------------------------

LOGS_SQL = f"""logs AS (SELECT 'scan' || (user_id % 4) AS scan_id, ts, CASE WHEN event_id % 2 = 0 THEN '~/logs/' ELSE '' END
    || CASE event_id % 3 WHEN 0 THEN 'mcp.log' ELSE 'exthost.log' END AS log_name,
  event_type || ' ' || CASE event_id % 6 WHEN 0 THEN 'GET https://u:p@h' || (user_id % 50) || '.example.com/a?token=' || (event_id % 4)
    WHEN 1 THEN 'wss://live' || (user_id % 9) || '.example.com/ws)' WHEN 2 THEN 'http://localhost:1/x https://telemetry.example.com/t'
    WHEN 3 THEN 'MCP server started' WHEN 4 THEN 'https://pypi.org/simple/p' || (user_id % 30) || ', ok' ELSE props END AS text FROM events)"""


def log_lines(spark, sf):
    return log_rows(table(spark, sf, "events"))


def log_rows(events):
    home = F.expr("concat('/home/u', user_id % 4)")
    path = F.expr("""concat(CASE event_id % 2 WHEN 0 THEN concat('/home/u', user_id % 4, '/logs/') ELSE '/var/log/' END,
      CASE event_id % 3 WHEN 0 THEN 'mcp.log' ELSE 'exthost.log' END)""")
    return events.withColumn("log_name", paths.scrub_home(path, home)).selectExpr(
        "concat('scan', user_id % 4) scan_id", "ts", "log_name",
        """concat(event_type, ' ', CASE event_id % 6 WHEN 0 THEN concat('GET https://u:p@h', user_id % 50, '.example.com/a?token=', event_id % 4)
    WHEN 1 THEN concat('wss://live', user_id % 9, '.example.com/ws)') WHEN 2 THEN 'http://localhost:1/x https://telemetry.example.com/t'
    WHEN 3 THEN 'MCP server started' WHEN 4 THEN concat('https://pypi.org/simple/p', user_id % 30, ', ok') ELSE props END) text""")


def _redacted(u):
    return (f"regexp_replace(regexp_replace({u}, {quote(P.URL_USERINFO)}, '://', 'g'), "
            f"{quote(P.URL_CREDENTIAL_PARAM)}, '\\1\\2=REDACTED', 'g')")


LOG_EVIDENCE_SQL = f"""{LOGS_SQL}, http AS (SELECT *, unnest(regexp_extract_all(text, {quote(P.HTTP_URL_LOG)})) AS u FROM logs),
  ws AS (SELECT *, unnest(regexp_extract_all(text, {quote(P.WS_URL_LOG)})) AS u FROM logs),
  ev AS (SELECT scan_id, ts, log_name, 'URL observed in ' || log_name AS detail, CASE WHEN {S.any_contains('lower(u)', N.REGISTRY_URL_PARTS)} THEN 'package-registry'
      WHEN {S.any_contains('lower(u)', N.LOCAL_URL_PARTS)} THEN 'local-endpoint' ELSE 'outbound-url' END AS category, {_redacted('u')} AS url
    FROM http WHERE NOT {S.any_contains('lower(u)', N.NOISY_URL_PARTS)}
    UNION ALL SELECT scan_id, ts, log_name, 'WebSocket observed in ' || log_name, 'websocket', {_redacted('u')} FROM ws
    UNION ALL SELECT scan_id, ts, log_name, 'MCP server on unix socket observed in ' || log_name, 'local-endpoint', NULL FROM logs WHERE contains(text, 'mcp.sock') OR contains(text, 'MCP server started'))"""


DISTINCT_LOG_URLS_SQL = f"""{LOG_EVIDENCE_SQL},
  d AS (SELECT scan_id, url, min(struct_pack(ts := ts, log_name := log_name, category := category, detail := detail)) AS m
    FROM ev WHERE url IS NOT NULL GROUP BY ALL)"""


def distinct_log_urls(spark, sf):
    lines = log_lines(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return LG.distinct_urls_batch(LG.log_evidence(lines))


@query("log_evidence", f"""WITH {DISTINCT_LOG_URLS_SQL}
  SELECT scan_id, epoch_us(m.ts) AS at, m.log_name AS log_name, m.category AS category, m.detail AS detail, url FROM d
  UNION ALL SELECT scan_id, epoch_us(ts), log_name, category, detail, url FROM ev WHERE url IS NULL""")
def log_evidence(spark, sf):
    return distinct_log_urls(spark, sf).select("scan_id", F.unix_micros("ts").alias("at"), "log_name", "category", "detail", "url")


@query("log_tails", f"""WITH {FILES_SQL}, l AS (SELECT file_id, dir || '/' || CASE file_id % 4 WHEN 0 THEN 'MCP-a.log' WHEN 1 THEN 'server.txt' WHEN 2 THEN 'other.log'
      ELSE 'copilot.log' END AS path, content || CASE WHEN file_id % 5 = 2 THEN chr(65533) || 'é' ELSE '' END || repeat(content, 12) AS text FROM files)
  SELECT path, sha256(text) AS text_hash, CAST(strlen(text) AS BIGINT) AS bytes FROM l
    WHERE path LIKE '%.log' AND (contains(lower(path), 'mcp-a') OR contains(path, 'copilot.log'))""")
def whole_logs(spark, sf):
    from riskledger.sources.files import log_texts
    name = F.expr("CASE file_id % 4 WHEN 0 THEN 'MCP-a.log' WHEN 1 THEN 'server.txt' WHEN 2 THEN 'other.log' ELSE 'copilot.log' END")
    broken = F.when(F.col("file_id") % 5 == 2, F.lit(bytearray(b"\xff" + "é".encode()))).otherwise(F.lit(bytearray()))
    body = F.col("content").cast("binary")
    logs = files(spark, sf).select(F.concat(paths.parent_dir(F.col("path")), F.lit("/"), name).alias("path"),
                                   F.concat(body, broken, F.repeat("content", F.lit(12)).cast("binary")).alias("content"), "modified_at")
    return log_texts(logs).select("path", F.sha2("text", 256).alias("text_hash"), F.octet_length("text").cast("bigint").alias("bytes"))


BAD_RULES_SQL = """r AS (SELECT p_partkey AS rule_rank, CASE p_partkey % 5 WHEN 0 THEN 'Rule ' || p_partkey ELSE 'rule-' || p_partkey END AS name,
    CASE p_partkey % 7 WHEN 0 THEN 'skill' WHEN 1 THEN '9bad' ELSE 'kind_' || p_size END AS artifact_type,
    p_size / 40.0 AS confidence, p_partkey % 11 = 0 AS no_match, CASE WHEN p_partkey % 6 = 0 THEN 'secret' ELSE 'kw' END AS prefix, p_size % 4 AS threshold,
    p_partkey % 8 = 3 AS broken FROM part)"""


def _rule_rows(base, **columns):
    """Rules with one block or none, from any table; columns that are not given are empty."""
    from riskledger.sources.rules import BLOCKS, RULE_SCHEMA
    block = "struct<terms:array<string>,signals_prefix:string,boost_confidence:double,boost_threshold:int>"
    none = F.array().cast("array<string>")
    plain = {"source": F.lit("user"), "description": F.lit(""), "filenames": none, "suffixes": none, "confidence": F.lit(0.0)}
    empty = {b: F.lit(None).cast(block) for b in BLOCKS}
    every = plain | empty | columns
    order = ["rule_rank", "source", "name", "description", "artifact_type", "filenames", "suffixes", "confidence", *BLOCKS]
    assert len(order) == RULE_SCHEMA.count(", ") + 1
    return base.select(*[every[c].alias(c) for c in order])


def _terms(terms, prefix="kw", boost=0.9, threshold=None):
    return F.struct(terms.alias("terms"), (F.lit(prefix) if isinstance(prefix, str) else prefix).alias("signals_prefix"),
                    F.lit(boost).alias("boost_confidence"), (F.lit(1) if threshold is None else threshold).cast("int").alias("boost_threshold"))


@query("rule_validation", f"""WITH {BAD_RULES_SQL}, e AS (
  SELECT rule_rank, 'name' AS field FROM r WHERE name LIKE 'Rule%' UNION ALL SELECT rule_rank, 'artifact_type' FROM r WHERE artifact_type IN ('skill', '9bad')
  UNION ALL SELECT rule_rank, 'match.confidence' FROM r WHERE confidence > 1 UNION ALL SELECT rule_rank, 'match' FROM r WHERE no_match
  UNION ALL SELECT rule_rank, 'keywords.signals_prefix' FROM r WHERE prefix = 'secret'
  UNION ALL SELECT rule_rank, 'keywords.boost_threshold' FROM r WHERE threshold < 1 OR threshold > 2
  UNION ALL SELECT rule_rank, 'patterns.terms' FROM r WHERE broken)
  SELECT CAST(rule_rank AS BIGINT) AS rule_rank, field FROM e""")
def rule_validation(spark, sf):
    from riskledger.sources.rules import rule_errors
    key = F.col("p_partkey")
    prefix = F.when(key % 6 == 0, "secret").otherwise("kw")
    patterns = F.when(key % 8 == 3, F.array(F.lit("ok"), F.lit("(")))        .otherwise(F.array(F.lit("[]a]$"), F.lit("\\u{200B}+")))
    rows = _rule_rows(
        table(spark, sf, "part"), rule_rank=key.cast("int"),
        name=F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('Rule ', p_partkey) ELSE concat('rule-', p_partkey) END"),
        artifact_type=F.expr("CASE p_partkey % 7 WHEN 0 THEN 'skill' WHEN 1 THEN '9bad' ELSE concat('kind_', p_size) END"),
        filenames=F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("*.x"))),
        confidence=(F.col("p_size") / 40.0).cast("double"),
        keywords=_terms(F.array(F.lit("one"), F.lit("two")), prefix, threshold=F.col("p_size") % 4), patterns=_terms(patterns, "rx"))
    return rule_errors(rows).select(F.col("rule_rank").cast("bigint").alias("rule_rank"), "field")


# two words of the letters a and b for each document, from the digest of its whole text; a text that joins two such
# words over and over can be read in two ways exactly if the words commute
WORDS_SQL = """w AS (SELECT doc_id, CAST(doc_id % 6 AS INT) AS kind, translate(substr(h, 3, 1 + strpos('0123456789abcdef', substr(h, 1, 1)) % 3), '0123456789abcdef', 'aaaaaaaabbbbbbbb') AS x,
    translate(substr(h, 9, 1 + strpos('0123456789abcdef', substr(h, 2, 1)) % 3), '0123456789abcdef', 'aaaaaaaabbbbbbbb') AS y FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents))"""


@query("expression_safety", f"""WITH {WORDS_SQL} SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE kind WHEN 0 THEN '(?:' || x || '|' || y || ')+$' WHEN 1 THEN '(?:(?:' || x || ')+(?:' || y || ')?)*c'
      WHEN 2 THEN '(?:' || x || ')*(?:' || y || ')*c' WHEN 3 THEN '(?:(?:' || x || '){{2}}|(?<n>' || y || '){{3}})*c' WHEN 4 THEN '(?=' || x || ')' || y ELSE '(?i)(?:' || x || '|' || upper(x) || 'c|' || y || 'c+)+$' END AS expression,
    CASE WHEN kind = 4 THEN 'needs a backtracking engine' WHEN kind IN (0, 3) AND x || y = y || x THEN 'can backtrack exponentially'
      WHEN kind = 1 OR kind = 5 AND x || y = y || x AND length(y) % length(x) = 0 THEN 'can backtrack exponentially' END AS error FROM w""")
def expression_safety(spark, sf):
    from riskledger.sources.rules import rule_errors
    digest = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    word = lambda at, size: F.expr(
        f"translate(substr(h, {at}, 1 + instr('0123456789abcdef', substr(h, {size}, 1)) % 3), '0123456789abcdef', 'aaaaaaaabbbbbbbb')")
    kinds = ["concat('(?:', x, '|', y, ')+$')", "concat('(?:(?:', x, ')+(?:', y, ')?)*c')", "concat('(?:', x, ')*(?:', y, ')*c')",
             "concat('(?:(?:', x, '){2}|(?<n>', y, '){3})*c')", "concat('(?=', x, ')', y)", "concat('(?i)(?:', x, '|', upper(x), 'c|', y, 'c+)+$')"]
    made = digest.select("doc_id", word(3, 1).alias("x"), word(9, 2).alias("y")).withColumn(
        "expression", F.expr("CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"))
    rows = _rule_rows(made, rule_rank=F.col("doc_id"), name=F.lit("made"), artifact_type=F.lit("made"), filenames=F.array(F.lit("x")),
                      patterns=_terms(F.array("expression"), "rx"))
    errors = rule_errors(rows).select(F.col("rule_rank").alias("doc_id"), "error").distinct()
    return made.select(F.col("doc_id").cast("bigint").alias("doc_id"), "expression").join(errors, "doc_id", "left")


# a rule for every part: whole names, endings, globs and expressions; every fifth states no confidence
USER_RULES_SQL = """r AS (SELECT p_partkey AS k, 'part-' || p_partkey AS rule_name, p_partkey % 4 AS kind, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 0.25 END AS base FROM part),
  f AS (SELECT doc_id, 'u' || (doc_id % 3000) || '-prompt.' || ['md', 'txt', 'tok'][doc_id % 3 + 1] AS name, text FROM documents),
  hit AS (SELECT f.doc_id, f.name, f.text, r.* FROM f JOIN r ON CASE kind WHEN 0 THEN f.name = 'u' || k || '-prompt.md' WHEN 1 THEN ends_with(f.name, k || '-prompt.txt')
    WHEN 2 THEN starts_with(f.name, 'u' || k || '-') ELSE f.name = 'u' || k || '-prompt.tok' END)"""


@query("user_rule_apply", f"""WITH {USER_RULES_SQL}, s AS (SELECT *, contains(lower(text), 'and') AS kw, kind = 3 AND regexp_matches(text, '[Tt]he[a-z]+ing') AS rx FROM hit)
  SELECT CAST(doc_id AS BIGINT) AS file_id, rule_name, CAST(CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS match_kind,
    CAST(CASE WHEN rx THEN 0.9 WHEN kw THEN greatest(base, 0.5) ELSE base END AS DOUBLE) AS confidence,
    'filename_match:' || name || CASE WHEN kw THEN '|kw:and' ELSE '' END || CASE WHEN rx THEN '|rx:[Tt]he[a-z]+ing' ELSE '' END AS signals FROM s""")
def user_rule_apply(spark, sf):
    from riskledger.operators import rules as RO
    from riskledger.sources.rules import accepted_rules
    part = table(spark, sf, "part").withColumn("kind", F.col("p_partkey") % 4)
    is_kind = lambda n, text: F.when(F.col("kind") == n, F.array(F.expr(text)))
    none = F.array().cast("array<string>")
    user = _rule_rows(
        part, rule_rank=F.col("p_partkey").cast("int"), name=F.concat(F.lit("part-"), "p_partkey"), artifact_type=F.lit("part_file"),
        filenames=F.coalesce(is_kind(0, "concat('U', p_partkey, '-prompt.md')"), is_kind(2, "concat('u', p_partkey, '-*')"),
                             is_kind(3, "concat('u', p_partkey, '-prompt.tok')"), none),
        suffixes=F.coalesce(is_kind(1, "concat(p_partkey, '-prompt.txt')"), none),
        confidence=F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(0.25), keywords=_terms(F.array(F.lit("and")), boost=0.5),
        patterns=F.when(F.col("kind") == 3, _terms(F.array(F.lit("[Tt]he[a-z]+ing")), "rx")))
    rules = accepted_rules(spark, user)[0].where("source = 'user'")
    kinds = F.array(F.lit("md"), F.lit("txt"), F.lit("tok"))
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), "text", F.lit(True).alias("content_ok"),
        F.concat(F.lit("u"), F.col("doc_id") % 3000, F.lit("-prompt."), F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int"))).alias("name"))
    found = RO.apply_rules(docs, rules, deep=True)
    own = F.filter("signals", lambda s: s.startswith("filename_match:") | s.startswith("kw:") | s.startswith("rx:"))
    return found.select("file_id", "rule_name", F.col("match_kind").cast("bigint").alias("match_kind"), "confidence", joined(own).alias("signals"))


@query("browser_footprints", """WITH d AS (SELECT 'scan' || (o_custkey % 4) AS scan_id, '/b/c' || o_custkey AS root, CASE o_orderkey % 3 WHEN 0 THEN 'Default' ELSE 'Profile ' || (o_orderkey % 3) END AS profile,
    'ext' || (o_orderkey % 40) AS ext FROM orders),
  pick AS (SELECT scan_id, root, min(struct_pack(other := profile <> 'Default', profile := profile)) AS m FROM d GROUP BY ALL),
  ids AS (SELECT DISTINCT d.scan_id, d.root, d.root || '/' || profile || '/Extensions' AS path, ext, left(sha256(ext), 2) AS share
    FROM d JOIN pick p ON d.scan_id = p.scan_id AND d.root = p.root AND d.profile = p.m.profile),
  shares AS (SELECT scan_id, root, path, share, count(*) AS n, sha256(string_agg(ext, chr(10) ORDER BY ext)) AS digest FROM ids GROUP BY ALL)
  SELECT scan_id, root AS profile_root, path, CAST(sum(n) AS BIGINT) AS extension_count, sha256(string_agg(digest, chr(10) ORDER BY share)) AS ids_digest
  FROM shares GROUP BY ALL""")
def browser(spark, sf):
    return D.browser_footprints(_extension_dirs(spark, sf)).select("scan_id", "profile_root", "path", "extension_count", "ids_digest")


def _extension_dirs(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "concat('scan', o_custkey % 4) scan_id", "concat('/b/c', o_custkey) profile_root",
        """concat('/b/c', o_custkey, '/', CASE o_orderkey % 3 WHEN 0 THEN 'Default' ELSE concat('Profile ', o_orderkey % 3) END,
           '/Extensions/ext', o_orderkey % 40) path""")


# --- streams ----------------------------------------------------------------------------------

def _folder(spark):
    """A new folder in the shared place the session names for checkpoints, or that was set in its context."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("streams need a shared folder: set spark.checkpoint.dir")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    batch = table(spark, sf, name)
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _finish(rows, folder):
    """Run a stream over everything present and read back what it wrote."""
    q = (rows.writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


@query("log_url_stream", f"""WITH {LOG_EVIDENCE_SQL}
  SELECT DISTINCT scan_id, category, string_split(detail, ' in ')[1] AS what, url FROM ev WHERE url IS NOT NULL
  UNION ALL SELECT scan_id, category, string_split(detail, ' in ')[1], url FROM ev WHERE url IS NULL""")
def log_url_stream(spark, sf):
    """Three runs of one stream: the newest third of the logs first, then the two older ones."""
    folder, events = _folder(spark), table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t")).first().t
    out = None
    for part in (at > high, (at > low) & (at <= high), (at <= low) | at.isNull()):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        lines = log_rows(source).withColumn("ts", F.col("ts").cast("timestamp"))
        rows = LG.distinct_urls(LG.log_evidence(lines)).select("scan_id", "category", F.split("detail", " in ")[0].alias("what"), "url")
        out = _finish(rows, folder)
    return out


@query("new_file_stream", f"""{A.DETECTED} SELECT f.path, c.artifact_type, {S.joined('c.signals')} AS signals
  FROM (SELECT file_id, artifact_type, signals FROM custom UNION ALL SELECT file_id, artifact_type, signals FROM mcp) c JOIN files f USING (file_id)""")
def new_file_stream(spark, sf):
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    rows = LG.stream_rule_artifacts(files_of(docs), options(spark)).select(
        "path", "artifact_type", joined("signals").alias("signals"))
    return _finish(rows, _folder(spark))


# Three batches: what is there, some of it in an older state; new, edited and unchanged files; deletions and
# changes that come too late.  The result is a cold scan of the last state, and shows which change was scanned.
CHANGE_BATCHES = [
    ("file_id % 7 <> 0", "file_id % 5 = 0", "1", "false"),
    ("file_id % 7 = 0 OR file_id % 5 = 0 OR file_id % 3 = 0", "false", "2", "false"),
    ("file_id % 11 = 0 OR file_id % 13 = 0", "file_id % 13 = 0", "CASE WHEN file_id % 11 = 0 THEN 3 ELSE 0 END", "file_id % 11 = 0"),
]
LAST_STATE = A.DETECTED.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 11 <> 0)")


@query("change_stream", f"""{LAST_STATE}, found AS (SELECT file_id, detector, rule_name, artifact_type, confidence, signals FROM custom
    UNION ALL SELECT file_id, detector, rule_name, artifact_type, confidence, signals FROM box
    UNION ALL SELECT file_id, detector, rule_name, artifact_type, confidence, signals FROM mcp)
  SELECT f.scan_id, f.path, c.detector, coalesce(c.rule_name, '') AS rule_name, c.artifact_type, CAST(c.confidence AS DOUBLE) AS confidence,
    {S.joined('c.signals')} AS signals, CAST(CASE WHEN file_id % 7 = 0 OR file_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS scanned_no
  FROM found c JOIN files f USING (file_id)""")
def change_stream(spark, sf):
    folder, ctx, corpus = _folder(spark), options(spark), files(spark, sf)
    schema = None
    for there, old, number, deleted in CHANGE_BATCHES:
        rows = corpus.where(there).withColumns({
            "content": F.when(F.expr(old), F.concat(F.lit("shell "), "content")).otherwise(F.col("content")),
            "change_no": F.expr(f"CAST({number} AS BIGINT)"), "deleted": F.expr(deleted)})
        rows.write.mode("append").parquet(f"{folder}/changes")
        schema = schema or RS.stored_schema(spark, rows, ctx)
        stream = LG.stream_new_files(spark, f"{folder}/changes", rows.schema)
        RS.follow(stream, f"{folder}/store", PROFILE, ctx, f"{folder}/state", schema).awaitTermination()
    found = RS.artifacts(spark, f"{folder}/store", schema, PROFILE)
    return found.select("scan_id", "path", "detector", F.coalesce("rule_name", F.lit("")).alias("rule_name"), "artifact_type",
                        "confidence", joined("signals").alias("signals"), "scanned_no")
