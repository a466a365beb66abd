"""Corpus selection, whole reads, identity keys and scalar columns."""

from pyspark.sql import functions as F

from fleet_queries import sqltext as S
from fleet_queries.corpus import FILES_SQL, files
from fleet_queries.registry import query, quote, str_list, table
from riskledger.catalog import names as N
from riskledger.functions import identity as I, paths, signals as G, text as T, urls as U
from riskledger.operators import corpus as C
from riskledger.operators.skills import skill_directory_files

BAD = b"\xff\xfe"


@query("utf8_head_reads", """WITH d AS (SELECT doc_id,
    CASE WHEN doc_id % 7 = 3 THEN 'mid' WHEN doc_id % 50 = 1 THEN 'head' ELSE 'good' END AS kind, text, chr(65533) || chr(65533) AS bad FROM documents),
  t AS (SELECT doc_id, kind, CASE kind WHEN 'mid' THEN text || bad || text WHEN 'head' THEN bad || text ELSE text END AS whole FROM d)
  SELECT doc_id, CAST(strlen(whole) - CASE WHEN kind = 'good' THEN 0 ELSE 4 END AS BIGINT) AS size, CAST(length(whole) AS BIGINT) AS chars,
    sha256(whole) AS text_hash, kind <> 'good' AS strict_missing FROM t""")
def utf8_reads(spark, sf):
    doc, body = F.col("doc_id"), F.col("text").cast("binary")
    bad = F.lit(bytearray(BAD))
    raw = (F.when(doc % 7 == 3, F.concat(body, bad, body)).when(doc % 50 == 1, F.concat(bad, body)).otherwise(body))
    df = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    df = df.select("doc_id", F.octet_length("raw").cast("bigint").alias("size"), T.utf8_text(F.col("raw")).alias("whole"),
                   T.strict_text(F.col("raw")).isNull().alias("strict_missing"))
    return df.select("doc_id", "size", F.length("whole").cast("bigint").alias("chars"), F.sha2("whole", 256).alias("text_hash"), "strict_missing")


REL = "string_split(substr(path, length(root) + 2), '/')"
DIRS = f"list_slice({REL}, 1, len({REL}) - 1)"


def _excluded(words):
    return f"len(list_intersect({DIRS}, {str_list(words)})) > 0"


NOISE = f"(list_position({DIRS}, '.vscode') > 0 AND NOT (list_position({DIRS}, '.vscode') = len({DIRS}) AND name = 'mcp.json'))"


@query("candidate_files", f"""WITH {FILES_SQL} SELECT path FROM files
  WHERE NOT {_excluded(N.EXCLUDED_DIRS)} AND NOT coalesce({NOISE}, FALSE)""")
def candidate_files(spark, sf):
    return C.candidates(files(spark, sf)).select("path")


@query("system_excluded_dirs", f"""WITH {FILES_SQL}, f AS (SELECT replace(path, '/src/', '/Library/') AS path, root, name FROM files)
  SELECT path FROM f WHERE {_excluded(N.EXCLUDED_DIRS + N.SYSTEM_EXCLUDED_DIRS)}""")
def system_excluded(spark, sf):
    df = files(spark, sf).withColumn("path", F.replace("path", F.lit("/src/"), F.lit("/Library/")))
    return df.where(C.below_excluded_dir(F.col("path"), F.col("root"), system=True)).select("path")


@query("depth_limit", f"""WITH {FILES_SQL}, f AS (SELECT path || '/a/b/' || name AS path, root, name FROM files)
  SELECT path, CAST(len({REL}) AS BIGINT) AS depth, len({REL}) > 5 AS deep FROM f
  WHERE NOT {_excluded(N.EXCLUDED_DIRS)} AND NOT coalesce({NOISE}, FALSE)""")
def depth_limit(spark, sf):
    df = files(spark, sf).withColumn("path", F.concat("path", F.lit("/a/b/"), paths.basename(F.col("path"))))
    depth = C.relative_depth(F.col("path"), F.col("root")).cast("bigint")
    return C.candidates(df).select("path", depth.alias("depth"), (depth > N.DEEP_PATH).alias("deep"))


@query("editor_dir_exception", f"""WITH {FILES_SQL}, f AS (SELECT path, root, name FROM files
    UNION ALL SELECT root || '/.vscode/extensions/' || file_id || '/mcp.json', root, 'mcp.json' FROM files
    UNION ALL SELECT root || '/.vscode/settings' || file_id || '.json', root, 'settings.json' FROM files)
  SELECT path FROM f WHERE coalesce({NOISE}, FALSE)""")
def editor_exception(spark, sf):
    f = files(spark, sf).select("path", "root", "file_id")
    vs = F.concat("root", F.lit("/.vscode/"))
    df = (f.select("path", "root")
          .unionAll(f.select(F.concat(vs, F.lit("extensions/"), "file_id", F.lit("/mcp.json")), "root"))
          .unionAll(f.select(F.concat(vs, F.lit("settings"), "file_id", F.lit(".json")), "root")))
    return df.where(C.editor_noise(F.col("path"), F.col("root"))).select("path")


def _homes(spark, sf):
    os_name = F.element_at(F.array(F.lit("linux"), F.lit("macos"), F.lit("windows")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("host"), "c_custkey").alias("scan_id"), os_name.alias("os"),
        F.concat(F.lit("/home/c"), "c_custkey").alias("home"))


_PLACES = [".claude/a.json", ".config/Code/User/mcp.json", "src/x/AGENTS.md", "notes.md", "Music/b.txt",
           "Library/Application Support/Cursor/User/mcp.json", "Developer/p/AGENTS.md", "git/r/.cursorrules"]


def _home_files(spark, sf):
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("host"), "o_custkey").alias("scan_id"),
        F.concat(F.lit("/home/c"), "o_custkey", F.lit("/"), place).alias("path")).distinct()


def _origin_sql():
    rows = []
    for os_name, base in N.EDITOR_BASE.items():
        rows += [(os_name, d, "host", 1) for d in N.HOST_CONFIG_DIRS]
        rows += [(os_name, f"{base}/{d}", "host", 1) for d in N.EDITOR_USER_DIRS]
        rows += [(os_name, d, "home", 2) for d in N.USER_SPACE_DIRS[os_name]]
    body = ", ".join(f"({quote(o)}, {quote(r)}, '{t}', {k})" for o, r, t, k in rows)
    place = " ".join(f"WHEN {i} THEN {quote(p)}" for i, p in enumerate(_PLACES))
    return f"""homes AS (SELECT 'host' || c_custkey AS scan_id, ['linux', 'macos', 'windows'][c_nationkey % 3 + 1] AS os,
        '/home/c' || c_custkey AS home FROM customer),
      tiers(os, rel, tier, tier_rank) AS (VALUES {body}),
      hf AS (SELECT DISTINCT 'host' || o_custkey AS scan_id,
        '/home/c' || o_custkey || '/' || CASE o_orderkey % 8 {place} END AS path FROM orders),
      placed AS (SELECT f.scan_id, f.path, 'home' AS tier, 0 AS tier_rank FROM hf f JOIN homes h USING (scan_id)
          WHERE regexp_extract(f.path, '^(.*)/[^/]*$', 1) = h.home
        UNION ALL SELECT f.scan_id, f.path, t.tier, t.tier_rank FROM hf f JOIN homes h USING (scan_id) JOIN tiers t USING (os)
          WHERE starts_with(f.path, h.home || '/' || t.rel || '/'))"""


@query("origin_tiers_first_wins", f"""WITH {_origin_sql()}
  SELECT scan_id, path, min_by(tier, tier_rank) AS origin FROM placed GROUP BY ALL""")
def origin_tiers(spark, sf):
    return C.assign_origin(_home_files(spark, sf), _homes(spark, sf))


@query("direct_home_files", f"WITH {_origin_sql()} SELECT scan_id, path FROM placed WHERE tier_rank = 0")
def direct_home(spark, sf):
    f = C.with_path_parts(_home_files(spark, sf))
    return f.join(_homes(spark, sf).select("scan_id", F.col("home").alias("dir")), ["scan_id", "dir"]).select("scan_id", "path")


@query("dedupe_first_origin", f"WITH {_origin_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path "
                              "ORDER BY tier_rank) AS n FROM placed) SELECT scan_id, path, tier, "
                              "CAST(tier_rank AS BIGINT) AS tier_rank FROM r WHERE n = 1")
def dedupe(spark, sf):
    found = C.tiers_of(_home_files(spark, sf), _homes(spark, sf))
    return C.dedupe_first_origin(found).withColumn("tier_rank", F.col("tier_rank").cast("bigint"))


_WALK = """row_number() OVER (PARTITION BY scan_id ORDER BY sha256(scan_id || '/' || path)) AS walk_rank, count(*) OVER (PARTITION BY scan_id) AS walk_total"""


@query("candidate_cap", f"WITH {FILES_SQL} SELECT scan_id, path, {_WALK} FROM files")
def walk_order(spark, sf):
    rows = C.in_walk_order(files(spark, sf).select("scan_id", "path"))
    return rows.select("scan_id", "path", F.col("walk_rank").cast("bigint").alias("walk_rank"), "walk_total")


@query("source_file_cap", f"""WITH {FILES_SQL}, e AS (SELECT * FROM files WHERE
    lower({S.ext_of('name')}) IN ({', '.join(quote(e) for e in N.SOURCE_EXTENSIONS)}) OR (lower({S.ext_of('name')}) = 'json'
    AND lower(name) NOT IN ({', '.join(quote(n) for n in N.JSON_SKIP_NAMES)})))
  SELECT scan_id, path, {_WALK} FROM e""")
def source_walk_order(spark, sf):
    from riskledger.operators.source_risk import eligible
    rows = C.in_walk_order(eligible(files(spark, sf)).select("scan_id", "path"))
    return rows.select("scan_id", "path", F.col("walk_rank").cast("bigint").alias("walk_rank"), "walk_total")


@query("content_allowlist", f"WITH {FILES_SQL} SELECT path, {S.content_allowed('name')} AS allowed FROM files")
def allowlist(spark, sf):
    return files(spark, sf).select("path", paths.content_allowed(paths.basename(F.col("path"))).alias("allowed"))


@query("source_and_json_eligibility", f"""WITH {FILES_SQL} SELECT path,
  lower({S.ext_of('name')}) IN ({', '.join(quote(e) for e in N.SOURCE_EXTENSIONS)}) AS is_source,
  lower({S.ext_of('name')}) = 'json' AND lower(name) NOT IN ({', '.join(quote(n) for n in N.JSON_SKIP_NAMES)}) AS is_json,
  lower({S.ext_of('name')}) IN ('', {', '.join(quote(e) for e in N.TEXT_EXTENSIONS)}) AS is_text FROM files""")
def eligibility(spark, sf):
    name = paths.basename(F.col("path"))
    return files(spark, sf).select("path", paths.is_source_file(name).alias("is_source"),
                                   paths.is_json_config(name).alias("is_json"), paths.is_text_file(name).alias("is_text"))


@query("ai_adjacent_scans", f"""WITH {FILES_SQL} SELECT scan_id, dir, bool_or({S.content_allowed('name')}) AS adjacent
  FROM files GROUP BY ALL""")
def adjacent(spark, sf):
    return C.with_path_parts(files(spark, sf)).groupBy("scan_id", "dir").agg(
        F.bool_or(paths.content_allowed(F.col("name"))).alias("adjacent"))


DEEP_FILES_SQL = """deep AS (SELECT scan_id, path, name FROM files
    UNION ALL SELECT scan_id, dir || '/a/b/c/d/e/f/g/' || file_id || '.md', file_id || '.md' FROM files WHERE lower(name) = 'skill.md')"""


@query("skill_directory_files", f"""WITH {FILES_SQL}, {DEEP_FILES_SQL} SELECT s.path AS skill_path, substr(f.path, length(s.dir) + 2) AS rel_path,
  lower({S.ext_of('f.name')}) IN ('', {', '.join(quote(e) for e in N.TEXT_EXTENSIONS)}) AS is_text
  FROM files s JOIN deep f ON f.scan_id = s.scan_id AND starts_with(f.path, s.dir || '/') WHERE lower(s.name) = 'skill.md'""")
def skill_dirs(spark, sf):
    own = files(spark, sf).select("scan_id", "path", "file_id")
    below = F.concat(paths.parent_dir(F.col("path")), F.lit("/a/b/c/d/e/f/g/"), "file_id", F.lit(".md"))
    deep = own.where(F.lower(paths.basename(F.col("path"))) == "skill.md").select("scan_id", below.alias("path"))
    return skill_directory_files(own.select("scan_id", "path").unionByName(deep)).select("skill_path", "rel_path", "is_text")


@query("detector_routing", """WITH d(detector, modes, cached) AS (VALUES """ + ", ".join(
    f"({quote(d)}, {str_list(m)}, {str_list(c) if c else 'CAST([] AS VARCHAR[])'})" for d, (m, c) in N.DETECTOR_MODES.items())
    + """), s AS (SELECT o_orderkey AS scan, ['host', 'scan', 'root', 'workdir', 'file'][o_orderkey % 5 + 1] AS mode FROM orders)
  SELECT mode, detector, list_contains(cached, mode) AS reusable, count(*) AS scans FROM s, d
  WHERE list_contains(modes, mode) GROUP BY ALL""")
def routing(spark, sf):
    from riskledger.operators.detectors import cacheable, detectors_for
    mode = F.element_at(F.array(*[F.lit(m) for m in N.MODES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    routes = F.expr("map(" + ", ".join(
        f"'{m}', array({', '.join(chr(39) + d + chr(39) for d in detectors_for(m))})" for m in N.MODES) + ")")
    reuse = [f"{m}/{d}" for m in N.MODES for d in N.DETECTOR_MODES if cacheable(m, d)]
    return (table(spark, sf, "orders").select(mode.alias("mode"))
            .withColumn("detector", F.explode(F.element_at(routes, F.col("mode"))))
            .withColumn("reusable", F.concat_ws("/", "mode", "detector").isin(reuse))
            .groupBy("mode", "detector", "reusable").agg(F.count("*").alias("scans")))


# --- URLs and scalars over the pages table ---------------------------------------------------

_FORMS = ["url", "replace(url, 'http://', 'https://u:p@x@')", "'http://10.1.2.' || (page_id % 300) || ':8080/x?api_token=' || page_id",
          "'https://[::1]:99/a#access_key%3Dabc&b=1'", "'ftp://files.example.org/'", "'http://localhost/ingest'",
          "'https://pypi.org/simple?auth=1'", "'no-scheme/' || page_id", "'https://172.' || (page_id % 40) || '.1.1/'", "'https:///x'"]
URLS_SQL = "u AS (SELECT page_id, CASE page_id % 10 " + " ".join(
    f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END AS u FROM pages)"


def _urls(spark, sf):
    forms = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS))
    return table(spark, sf, "pages").select("page_id", F.expr(f"CASE page_id % 10 {forms} END").alias("u"))


@query("url_redaction_and_class", f"""WITH {URLS_SQL}
  SELECT page_id, regexp_replace(regexp_replace(u, '://[^/?#\\s]*@', '://', 'g'),
      '(?i)([?&#])([^=&#\\s]*(?:token|key|secret|password|auth|credential|apikey)[^=&#\\s]*)(?:=|%3d)[^&#\\s]*', '\\1\\2=REDACTED', 'g') AS safe,
    CASE WHEN {S.any_contains('lower(u)', N.REGISTRY_URL_PARTS)} THEN 'package-registry'
      WHEN {S.any_contains('lower(u)', N.LOCAL_URL_PARTS)} THEN 'local-endpoint' ELSE 'outbound-url' END AS class,
    regexp_extract(CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE u END, '^([^/?#]*)', 1) AS authority,
    string_split(CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE u END, '/')[1] AS display_host FROM u""")
def url_redaction(spark, sf):
    u = F.col("u")
    return _urls(spark, sf).select("page_id", U.redact_url(u).alias("safe"), U.url_class(u).alias("class"),
                                   U.url_authority(u).alias("authority"), U.display_host(u).alias("display_host"))


HOST_SQL = """h AS (SELECT page_id, u, string_split(u, '://')[1] AS scheme,
    string_split(CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE u END, '/')[1] AS auth FROM u),
  hh AS (SELECT *, CASE WHEN starts_with(auth, '[') THEN string_split(substr(auth, 2), ']')[1]
    WHEN length(auth) - length(replace(auth, ':', '')) = 1 THEN string_split(auth, ':')[1] ELSE auth END AS host FROM h),
  oc AS (SELECT *, list_transform(CASE WHEN regexp_full_match(host, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') THEN string_split(host, '.')
    ELSE CAST([] AS VARCHAR[]) END, lambda x: CAST(x AS INTEGER)) AS o FROM hh),
  pv AS (SELECT *, lower(host) IN ('localhost', '::1') OR (len(o) = 4 AND list_max(o) < 256 AND (o[1] IN (10, 127)
    OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168))) AS private FROM oc)"""


@query("endpoint_policy", f"""WITH {URLS_SQL}, {HOST_SQL}
  SELECT page_id, host, private, CASE WHEN NOT contains(u, '://') THEN 'missing_scheme'
    WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN host = '' THEN 'no_host'
    WHEN scheme = 'http' AND NOT private THEN 'public_http' WHEN NOT private THEN 'public_not_allowed' ELSE 'allowed' END AS status FROM pv""")
def endpoint_policy(spark, sf):
    u = F.col("u")
    host = U.strip_port(U.display_host(u))
    return _urls(spark, sf).select("page_id", host.alias("host"), U.is_private_host(host).alias("private"),
                                   U.endpoint_status(u).alias("status"))


@query("git_remote_sanitize", """WITH r AS (SELECT s_suppkey, CASE s_suppkey % 6
    WHEN 0 THEN 'https://user:tok@github.com/o/r' || s_suppkey || '.git' WHEN 1 THEN 'git@github.com:org/r' || s_suppkey || '.git'
    WHEN 2 THEN 'ssh://git@host.example/x@y' WHEN 3 THEN '/srv/git/' || s_name WHEN 4 THEN 'file:///srv/x'
    ELSE 'git://host/r' END AS remote FROM supplier)
  SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'https://github.com/o/r' || s_suppkey || '.git'
    WHEN 1 THEN 'ssh://github.com/org/r' || s_suppkey || '.git' WHEN 2 THEN 'ssh://host.example/x@y'
    WHEN 5 THEN 'git://host/r' ELSE 'unknown' END AS remote FROM r""")
def git_remote(spark, sf):
    remote = F.expr("""CASE s_suppkey % 6 WHEN 0 THEN concat('https://user:tok@github.com/o/r', s_suppkey, '.git')
      WHEN 1 THEN concat('git@github.com:org/r', s_suppkey, '.git') WHEN 2 THEN 'ssh://git@host.example/x@y'
      WHEN 3 THEN concat('/srv/git/', s_name) WHEN 4 THEN 'file:///srv/x' ELSE 'git://host/r' END""")
    return table(spark, sf, "supplier").select("s_suppkey", U.sanitize_remote(remote).alias("remote"))


@query("semver_compare", """WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v' ELSE '' END || (p_size % 3) || '.' || (p_partkey % 12)
      || CASE WHEN p_partkey % 5 = 4 THEN '' ELSE '.' || (p_size % 10) END || CASE WHEN p_partkey % 17 = 0 THEN '-rc1' ELSE '' END AS ver FROM part),
    p AS (SELECT p_partkey, ver, regexp_matches(ver, '^v?[0-9]+\\.[0-9]+\\.[0-9]+$') AS ok,
      string_split(regexp_replace(ver, '^v', ''), '.') AS s FROM v)
  SELECT p_partkey, ok AS parsed, CASE WHEN ok THEN (CAST(s[1] AS BIGINT), CAST(s[2] AS BIGINT), CAST(s[3] AS BIGINT)) < (1, 10, 3) END AS older FROM p""")
def semver(spark, sf):
    ver = F.expr("""concat(CASE p_partkey % 4 WHEN 0 THEN 'v' ELSE '' END, p_size % 3, '.', p_partkey % 12,
      CASE WHEN p_partkey % 5 = 4 THEN '' ELSE concat('.', p_size % 10) END, CASE WHEN p_partkey % 17 = 0 THEN '-rc1' ELSE '' END)""")
    parsed = T.semver(ver)
    limit = F.expr("named_struct('major', 1L, 'minor', 10L, 'patch', 3L)")
    return table(spark, sf, "part").select("p_partkey", parsed.isNotNull().alias("parsed"), (parsed < limit).alias("older"))


@query("qualified_names", f"""WITH {FILES_SQL} SELECT path, string_split(dir, '/')[-1] || '/' ||
    CASE WHEN starts_with(name, '.') THEN name ELSE coalesce(nullif(regexp_extract(name, '^(.+)\\.[^.]*$', 1), ''), name) END AS qualified,
    CASE WHEN file_id % 2 = 0 THEN '~/' || substr(path, length(root) + 2) ELSE name END AS shown FROM files""")
def qualified(spark, sf):
    path = F.col("path")
    home = F.when(F.col("file_id") % 2 == 0, F.col("root"))
    return files(spark, sf).select("path", paths.qualified_name(path).alias("qualified"), paths.scrub_home(path, home).alias("shown"))


@query("file_primitives", f"""WITH {FILES_SQL}, big AS (SELECT path, content AS body FROM files
    UNION ALL SELECT path || '.big', repeat(content, CAST(9000000 // size_bytes + 1 AS BIGINT)) || file_id FROM files WHERE file_id % 500 = 7)
  SELECT path, sha256(body) AS content_hash, 'full_sha256' AS mode, CAST(strlen(body) AS BIGINT) AS hashed FROM big""")
def primitives(spark, sf):
    f = files(spark, sf).select("file_id", "path", "content", "size_bytes")
    body = F.concat(F.repeat("content", F.expr("int(9000000 div size_bytes + 1)")), F.col("file_id").cast("string"))
    big = f.where("file_id % 500 = 7").select(F.concat("path", F.lit(".big")).alias("path"), body.alias("content"))
    return f.select("path", "content").unionByName(big).select(
        "path", I.content_hash(F.col("content")).alias("content_hash"), F.lit(I.HASH_MODE).alias("mode"),
        F.octet_length("content").cast("bigint").alias("hashed"))


@query("file_state_keys", f"""WITH {FILES_SQL} SELECT path, sha256(path || ':' || origin || ':' ||
    CASE WHEN file_id % 3 = 0 THEN '' ELSE '7:' || file_id END || ':' || size_bytes || ':' || epoch_ns(modified_at) || ':' || sha256(content)) AS state_key
  FROM files""")
def state_keys(spark, sf):
    df = files(spark, sf)
    inode = F.when(F.col("file_id") % 3 != 0, F.concat(F.lit("7:"), "file_id"))
    return df.select("path", I.state_key(F.col("path"), F.col("origin"), inode, F.col("size_bytes"),
                                         F.unix_micros("modified_at") * 1000, F.sha2("content", 256)).alias("state_key"))
