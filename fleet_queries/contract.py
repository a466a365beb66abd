"""Contract entities, links and payload over the derived files."""

from pyspark.sql import functions as F

from fleet_queries import artifact_sql as A, sqltext as S
from fleet_queries.artifacts import _memo, artifacts, joined, options
from fleet_queries.changes import DISTINCT_LOG_URLS_SQL, distinct_log_urls
from fleet_queries.corpus import FILES_SQL, files
from fleet_queries.registry import query, quote, str_list, table
from riskledger.catalog import labels as L, names as N, patterns as P
from riskledger.operators import entities as E, links, mcp_servers as M, skills as K
from riskledger.plans import contract as plan

READABLE = ", ".join(quote(n) for n in N.MCP_NAMES if n in N.CONTENT_NAMES)
WORDS = quote("|".join(L.SECRET_FLAG_WORDS))


def _secret(x):
    bare = f"regexp_replace(lower({x}), '^(?:--)?-?', '')"
    return f"(regexp_matches({bare}, {WORDS}) OR {bare} = 'k')"


def _redacted(u):
    return (f"regexp_replace(regexp_replace({u}, {quote(P.URL_USERINFO)}, '://', 'g'), "
            f"{quote(P.URL_CREDENTIAL_PARAM)}, '\\1\\2=REDACTED', 'g')")


def _class(u):
    return (f"CASE WHEN {S.any_contains(f'lower({u})', N.REGISTRY_URL_PARTS)} THEN 'package-registry' "
            f"WHEN {S.any_contains(f'lower({u})', N.LOCAL_URL_PARTS)} THEN 'local-endpoint' ELSE 'outbound-url' END")


_PACKAGE = "CASE " + " ".join(
    f"WHEN {S.any_contains('ptext', marks)} THEN {quote(f'Known package {chr(39)}{p}{chr(39)}: {b}')}"
    for marks, p, b in L.KNOWN_PACKAGES) + " END"

SERVERS_SQL = f"""
entry_keys AS (SELECT scan_id, path, dir, content, unnest(json_keys(content::JSON, '$.mcpServers')) AS server_name
  FROM files WHERE name IN ({READABLE})),
entries AS (SELECT scan_id, path, dir, server_name,
  json_extract(content::JSON, '$.mcpServers."' || server_name || '"') AS value FROM entry_keys),
ranked_entries AS (SELECT *, row_number() OVER (PARTITION BY scan_id, server_name ORDER BY path) AS n FROM entries),
srv AS (
  SELECT scan_id, path, dir, server_name, value, CAST(value AS VARCHAR) AS vt,
    regexp_replace(CAST(value AS VARCHAR), ',"version":"[^"]*"', '') AS runtime,
    value->>'$.command' AS command, value->>'$.url' AS url, value->>'$.type' AS type,
    json_extract_string(value, '$.args[*]') AS args,
    CASE WHEN type = 'http' THEN 'streamable-http' WHEN type IS NOT NULL THEN type WHEN url IS NOT NULL THEN 'sse'
      WHEN command IS NOT NULL THEN 'stdio' ELSE 'unknown' END AS transport,
    lower(coalesce(command, '') || ' ' || array_to_string(args, ' ') || ' ' || server_name) AS ptext
  FROM ranked_entries WHERE n = 1
),
evidence_raw AS (
  SELECT scan_id, server_name, 1 AS kind, 0 AS idx, 'config' AS source, 'transport' AS category, 'Transport: ' || transport || ' — ' ||
    {A.lookup(L.TRANSPORT_DETAIL, 'transport', "'Unknown transport'")} AS detail, CAST(NULL AS VARCHAR) AS url FROM srv
  UNION ALL SELECT scan_id, server_name, 2, 0, 'config', {_class('url')}, 'Server endpoint: ' || {_redacted('url')}, {_redacted('url')}
    FROM srv WHERE url IS NOT NULL
  UNION ALL SELECT scan_id, server_name, 3, i, 'config', {_class('u')}, 'URL in server config: ' || {_redacted('u')}, {_redacted('u')} FROM (
    SELECT scan_id, server_name, url, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (
      SELECT *, regexp_extract_all(runtime, {quote(P.HTTP_URL)}) AS l FROM srv)) WHERE url IS NULL OR u <> url
  UNION ALL SELECT scan_id, server_name, 4, i, 'config', 'websocket', 'WebSocket URL: ' || {_redacted('u')}, {_redacted('u')} FROM (
    SELECT scan_id, server_name, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (
      SELECT *, regexp_extract_all(runtime, {quote(P.WS_URL)}) AS l FROM srv))
  UNION ALL SELECT scan_id, server_name, 5, i, 'config', 'credential-in-env', 'Credential env var ''' || k || ''' passed to server (value ' ||
    CASE WHEN coalesce(value->>('$.env."' || k || '"'), '') <> '' THEN 'present' ELSE 'empty' END || ')', NULL FROM (
    SELECT scan_id, server_name, value, unnest(l) AS k, generate_subscripts(l, 1) AS i FROM (
      SELECT *, list_sort(json_keys(value, '$.env')) AS l FROM srv)) WHERE {S.any_contains('lower(k)', L.ENV_CREDENTIAL_WORDS)}
  UNION ALL SELECT scan_id, server_name, 6, 0, 'package-info', 'known-behavior', {_PACKAGE}, NULL FROM srv WHERE {_PACKAGE} IS NOT NULL
),
evidence AS (SELECT scan_id, server_name, row_number() OVER (PARTITION BY scan_id, server_name ORDER BY kind, idx) - 1 AS pos,
  source, category, detail, url FROM evidence_raw),
classed AS (
  SELECT s.*, CASE
    WHEN bool_or(e.category = 'outbound-url') OR bool_or(e.category <> 'local-endpoint' AND e.url IS NOT NULL
        AND s.transport IN ('sse', 'streamable-http'))
      OR bool_or(e.category = 'known-behavior' AND (contains(e.detail, 'internet') OR contains(e.detail, 'Outbound HTTPS')
        OR contains(e.detail, 'api.github'))) THEN 'Internet Exposed'
    WHEN bool_or(e.category IN ('local-endpoint', 'websocket')) THEN 'LAN' ELSE 'Local Only' END AS network
  FROM srv s JOIN evidence e ON s.scan_id = e.scan_id AND s.server_name = e.server_name
  GROUP BY ALL
),
arg_rows AS (SELECT scan_id, server_name, unnest(args) AS arg, generate_subscripts(args, 1) AS i FROM srv),
arg_marks AS (SELECT *, CASE WHEN starts_with(arg, '-') THEN instr(arg, '=') > 2 ELSE instr(arg, '=') > 1 END AS assigned,
  left(arg, instr(arg, '=') - 1) AS key FROM arg_rows),
arg_bare AS (SELECT *, NOT assigned AND NOT contains(lower(arg), 'bearer ') AND {_secret('arg')} AS bare FROM arg_marks),
arg_out AS (SELECT scan_id, server_name, i, CASE
    WHEN lag(bare) OVER (PARTITION BY scan_id, server_name ORDER BY i) THEN 'REDACTED'
    WHEN assigned AND {_secret('key')} THEN key || '=REDACTED' WHEN assigned THEN arg
    WHEN contains(lower(arg), 'bearer ') THEN 'REDACTED' ELSE arg END AS shown FROM arg_bare),
commands AS (SELECT s.scan_id, s.server_name, concat_ws(' ', coalesce(command, ''),
    (SELECT string_agg(shown, ' ' ORDER BY i) FROM arg_out a WHERE a.scan_id = s.scan_id AND a.server_name = s.server_name)) AS command_line FROM srv s)"""

SERVERS = f"WITH {FILES_SQL}, {SERVERS_SQL}"


def servers(spark, sf):
    return _memo("servers", spark, sf, lambda: M.mcp_servers(files(spark, sf), options(spark)))


@query("mcp_server_rows", f"""{SERVERS} SELECT c.scan_id, c.server_name, c.path, c.server_name || '-' || left(sha256(c.path), 12) AS id,
  transport, network, CASE WHEN {S.any_contains('lower(vt)', N.CREDENTIAL_TOKENS + ['${', 'process.env', 'os.environ'])}
    THEN 'API Key' ELSE 'None' END AS auth, command_line FROM classed c JOIN commands m USING (scan_id, server_name)""")
def server_rows(spark, sf):
    return servers(spark, sf).select("scan_id", "server_name", "path", "id", "transport", "network", "auth", "command_line")


@query("network_evidence", f"{SERVERS} SELECT scan_id, server_name, CAST(pos AS BIGINT) AS pos, source, category, detail, url FROM evidence")
def evidence(spark, sf):
    return (servers(spark, sf).select("scan_id", "server_name", F.posexplode("evidence").alias("pos", "e"))
            .select("scan_id", "server_name", F.col("pos").cast("bigint").alias("pos"), "e.source", "e.category", "e.detail", "e.url"))


@query("server_tools", f"""{SERVERS}, listed AS (SELECT scan_id, server_name, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (
    SELECT *, json_extract(value, '$.tools[*]') AS ts FROM srv))
  SELECT scan_id, server_name, CAST(pos - 1 AS BIGINT) AS pos, coalesce(t->>'$.name', 'unknown') AS tool, 'Medium' AS risk,
    coalesce(t->>'$.description', '') AS description FROM listed
  UNION ALL SELECT scan_id, server_name, 0, 'run_shell_command', 'High', 'Shell execution via ' || server_name FROM srv
    WHERE coalesce(len(json_extract(value, '$.tools[*]')), 0) = 0 AND (contains(coalesce(command, ''), 'sh')
      OR len(list_filter(args, lambda a: contains(a, 'sh'))) > 0)""")
def server_tools(spark, sf):
    return (servers(spark, sf).select("scan_id", "server_name", F.posexplode("tools").alias("pos", "t"))
            .select("scan_id", "server_name", F.col("pos").cast("bigint").alias("pos"), F.col("t.name").alias("tool"),
                    "t.risk", "t.description"))


@query("server_env_references", f"""{SERVERS}, refs AS (SELECT scan_id, server_name, unnest(l) AS name, generate_subscripts(l, 1) AS i, 'config' AS source_key
    FROM (SELECT *, list_distinct(regexp_extract_all(vt, {quote(P.ENV_VAR)}, 1)) AS l FROM srv)
  UNION ALL SELECT scan_id, server_name, unnest(l), 1000 + generate_subscripts(l, 1), 'env' FROM (
    SELECT *, list_sort(list_filter(json_keys(value, '$.env'),
      lambda k: NOT list_contains(regexp_extract_all(vt, {quote(P.ENV_VAR)}, 1), k))) AS l FROM srv))
  SELECT scan_id, server_name, CAST(row_number() OVER (PARTITION BY scan_id, server_name ORDER BY i) - 1 AS BIGINT) AS ord, name, source_key,
    source_key = 'env' OR (name = 'TOK' AND scan_id = 'scan1') AS is_set FROM refs""")
def env_refs(spark, sf):
    host = files(spark, sf).where("scan_id = 'scan1'").select("scan_id", F.lit("TOK").alias("name")).distinct()
    return M.env_references(servers(spark, sf), host).withColumn("ord", F.col("ord").cast("bigint"))


@query("log_evidence_attach", f"""{SERVERS}, {DISTINCT_LOG_URLS_SQL},
  auth AS (SELECT scan_id, server_name, regexp_extract(substr(e.url, instr(e.url, '://') + 3), '^([^/?#]*)', 1) AS authority, s.path
    FROM evidence e JOIN srv s USING (scan_id, server_name) WHERE e.url IS NOT NULL),
  firsts AS (SELECT scan_id, authority, min(struct_pack(path := path, server_name := server_name)) AS m FROM auth GROUP BY ALL)
  SELECT l.scan_id, f.m.server_name AS server_name, l.m.category AS category, l.m.detail AS detail, l.url FROM d l JOIN firsts f ON l.scan_id = f.scan_id
    AND regexp_extract(substr(l.url, instr(l.url, '://') + 3), '^([^/?#]*)', 1) = f.authority""")
def attach(spark, sf):
    return M.attach_logs(servers(spark, sf), distinct_log_urls(spark, sf)).select("scan_id", "server_name", "category", "detail", "url")


# --- prompts, agents, links -------------------------------------------------------------------

NAME = ("string_split(dir, '/')[-1] || '/' || CASE WHEN starts_with(name, '.') THEN name "
        "ELSE coalesce(nullif(regexp_extract(name, '^(.+)\\.[^.]*$', 1), ''), name) END")
ENTITY_SQL = f"""
entity AS (SELECT *, {NAME} AS entity_name, path || ':' || left(artifact_hash, 12) AS entity_id,
  CASE WHEN content_ok THEN CASE WHEN contains(content, '$') THEN '$' WHEN contains(content, 'process.env.') THEN 'process.env.'
    WHEN contains(content, 'os.environ') THEN 'os.environ' END END AS env_marker,
  content_ok AND {S.any_contains('lower(content)', ['{{', '{%', '${'])} AS template_surface,
  content_ok AND {S.any_contains('lower(content)', ['user_input', 'user_message'])} AS user_surface
  FROM artifacts WHERE file_id IS NOT NULL),
agents AS (
  SELECT scan_id, path, dir, entity_id AS id, entity_name AS name, declared_tools, caps, signals, verification_status, risk_score,
    CASE WHEN len(list_intersect(caps, ['code_execution', 'shell_execution'])) > 0 THEN 'Code'
      WHEN len(list_intersect(caps, ['container_runtime', 'dependency_execution'])) > 0 THEN 'Automation'
      WHEN len(list_intersect(caps, ['browser_access', 'external_api_calls'])) > 0 THEN 'Research' ELSE 'System' END AS classification,
    CASE WHEN dk OR combo THEN 'Autonomous' ELSE 'User-in-the-loop' END AS execution_model
  FROM entity WHERE artifact_type = 'agents_md'
),
markers(m) AS (VALUES {', '.join(f'({quote(m)})' for m in N.SCOPE_MARKERS)}),
agent_dirs AS (SELECT DISTINCT scan_id, dir AS agent_dir FROM agents),
links AS (
  SELECT a.scan_id, a.agent_dir, e.server_name, min(e.path) AS first_path FROM agent_dirs a JOIN entries e ON a.scan_id = e.scan_id
    AND (starts_with(a.agent_dir, e.dir) OR starts_with(e.dir, a.agent_dir)
      OR EXISTS (SELECT 1 FROM markers WHERE contains(a.agent_dir, m) AND contains(e.dir, m)))
  GROUP BY ALL
),
agents_n AS (SELECT a.*, len(declared_tools) + coalesce(n, 0) AS tool_count FROM agents a LEFT JOIN (
  SELECT scan_id, agent_dir, count(*) AS n FROM links GROUP BY ALL) l ON a.scan_id = l.scan_id AND a.dir = l.agent_dir)"""
ENTITIES = f"{A.ARTIFACTS}, {SERVERS_SQL}, {ENTITY_SQL}"


def repos(spark, sf):
    g = F.col("g")
    base = table(spark, sf, "documents").select(F.expr("doc_id div 16").alias("g")).distinct()
    user = F.concat(F.lit("/home/u"), g % 4)
    remote = F.expr("""CASE g % 3 WHEN 0 THEN concat('https://tok@github.com/o/r', g, '.git')
      WHEN 1 THEN concat('git@gitlab.com:o/r', g) ELSE '/local/path' END""")
    own = base.where("g % 2 = 0").select(
        F.concat(F.lit("scan"), g % 4).alias("scan_id"), F.concat(user, F.lit("/proj"), g).alias("dir"),
        remote.alias("remote"), F.when(g % 4 == 0, "ref: refs/heads/dev").otherwise("0a1b2c").alias("head"))
    roots = base.where("g % 4 = 1").select(
        F.lit("scan1").alias("scan_id"), F.lit("/home/u1").alias("dir"),
        F.lit("https://github.com/root/u1").alias("remote"), F.lit("ref: refs/heads/trunk").alias("head")).distinct()
    return own.unionByName(roots)


REPOS_SQL = """
repos AS (
  SELECT DISTINCT 'scan' || (g % 4) AS scan_id, '/home/u' || (g % 4) || '/proj' || g AS dir,
    CASE g % 3 WHEN 0 THEN 'https://github.com/o/r' || g || '.git' WHEN 1 THEN 'ssh://gitlab.com/o/r' || g ELSE 'unknown' END AS remote,
    CASE WHEN g % 4 = 0 THEN 'dev' ELSE 'main' END AS branch FROM (SELECT doc_id // 16 AS g FROM documents) WHERE g % 2 = 0
  UNION ALL SELECT DISTINCT 'scan1', '/home/u1', 'https://github.com/root/u1', 'trunk' FROM documents WHERE doc_id // 16 % 4 = 1)"""


def built(spark, sf):
    return _memo("contract", spark, sf, lambda: plan.Contract(
        files(spark, sf), artifacts(spark, sf), options(spark), repos(spark, sf)))


@query("partition_by_type", f"""{ENTITIES} SELECT scan_id,
  CAST(count(*) FILTER (WHERE artifact_type IN ('cursor_rules', 'prompt_config', 'agents_md')) AS BIGINT) AS prompts,
  CAST(count(*) FILTER (WHERE artifact_type = 'agents_md') AS BIGINT) AS agents,
  CAST(count(*) FILTER (WHERE artifact_type = 'mcp_config') AS BIGINT) AS mcp,
  CAST(count(*) FILTER (WHERE starts_with(artifact_type, 'container_')) AS BIGINT) AS containers FROM artifacts GROUP BY scan_id""")
def partition_by_type(spark, sf):
    kind = F.col("artifact_type")
    return artifacts(spark, sf).groupBy("scan_id").agg(
        F.count_if(kind.isin(E.PROMPT_TYPES)).alias("prompts"), F.count_if(kind == "agents_md").alias("agents"),
        F.count_if(kind == "mcp_config").alias("mcp"), F.count_if(kind.isin(E.CONTAINER_TYPES)).alias("containers"))


@query("prompt_records", f"""{ENTITIES} SELECT entity_id AS id, entity_name AS name,
  CASE WHEN artifact_type = 'prompt_config' THEN 'User Prompt' ELSE 'System Prompt' END AS classification,
  CAST(size_bytes // 4 AS BIGINT) AS tokens, sha256(content) AS content_hash, strftime(modified_at, '%Y-%m-%d') AS last_changed_date,
  array_to_string(list_transform(caps, lambda c: {A.lookup(L.CAPABILITY_LABEL, 'c')} || '/' || {A.lookup(L.CAPABILITY_LEVEL, 'c', "'info'")}), '|') AS capabilities,
  CASE WHEN list_contains(signals, 'credential_exposure_signal') THEN 'Redacted — matched known secret pattern'
    WHEN env_marker IS NOT NULL THEN 'References environment variable via ' || env_marker ELSE '' END AS secret_refs,
  array_to_string(list_concat(list_transform(list_filter(signals, lambda s: starts_with(s, 'dangerous_')), lambda s:
      CASE WHEN starts_with(s, 'dangerous_combo') THEN 'Combined shell + network + filesystem access pattern'
        ELSE 'Dangerous instruction keyword: ' || string_split(s, ':')[2] END),
    CASE WHEN template_surface THEN ['Template interpolation detected — potential injection surface'] ELSE {A.EMPTY} END,
    CASE WHEN user_surface THEN ['Direct user input reference in prompt body'] ELSE {A.EMPTY} END), '|') AS surfaces,
  risk_score FROM entity WHERE artifact_type IN ('cursor_rules', 'prompt_config', 'agents_md')""")
def prompt_records(spark, sf):
    p = E.prompts(artifacts(spark, sf))
    return p.select("id", "name", "classification", "tokens", "content_hash", "last_changed_date",
                    joined(F.transform("capabilities", lambda c: F.concat(c["text"], F.lit("/"), c["level"]))).alias("capabilities"),
                    joined(F.transform("secret_refs", lambda c: c["detail"])).alias("secret_refs"),
                    joined(F.transform("injection_surfaces", lambda c: c["text"])).alias("surfaces"),
                    F.col("risk_score").cast("bigint").alias("risk_score"))


@query("agent_records", f"""{ENTITIES}, {REPOS_SQL}, nearest AS (SELECT a.id, max_by(r.remote, length(r.dir)) AS remote FROM agents a
    JOIN repos r ON a.scan_id = r.scan_id AND (a.dir = r.dir OR starts_with(a.dir, r.dir || '/')) GROUP BY a.id)
  SELECT a.id, a.name, classification, execution_model, CAST(greatest(0, 100 - risk_score) AS BIGINT) AS trust_score,
    coalesce(n.remote, 'unknown') AS source_repo, CAST(tool_count AS BIGINT) AS tool_count,
    array_to_string(list_transform([['Filesystem', 'filesystem_access', ''], ['Browser', 'browser_access', ''],
      ['Network', 'network_access', 'external_api_calls'], ['Shell', 'shell_execution', 'code_execution'],
      ['Database', 'database_access', '']],
      lambda f: f[1] || '=' || CASE WHEN list_contains(caps, f[2]) OR list_contains(caps, f[3]) THEN 'true' ELSE 'false' END), '|') AS flags,
    CAST(10 + len(list_filter(signals, lambda s: s = 'credential_exposure_signal')) * -25
      + len(list_filter(signals, lambda s: s = {quote(P.COMBO_SIGNAL)})) * -30
      + len(list_filter(signals, lambda s: starts_with(s, 'dangerous_keyword:'))) * -15
      + CASE WHEN verification_status IN ('info', 'low') THEN 15 ELSE 0 END AS BIGINT) AS trust_delta
  FROM agents_n a LEFT JOIN nearest n ON a.id = n.id""")
def agent_records(spark, sf):
    a = built(spark, sf).agents
    return a.select("id", "name", "classification", "execution_model",
                    F.col("trust_score").cast("bigint").alias("trust_score"), "source_repo",
                    F.col("tool_count").cast("bigint").alias("tool_count"),
                    joined(F.transform("capabilities", lambda c: F.concat(c["name"], F.lit("="), c["enabled"].cast("string")))).alias("flags"),
                    F.aggregate("trust_breakdown", F.lit(0), lambda t, f: t + f["delta"]).cast("bigint").alias("trust_delta"))


@query("agent_server_links", f"{ENTITIES} SELECT scan_id, agent_dir, server_name, first_path FROM links")
def agent_links(spark, sf):
    return built(spark, sf).server_links.select("scan_id", "agent_dir", "server_name", "first_path")


@query("agent_reach_counts", f"""{ENTITIES} SELECT a.scan_id, a.agent_dir, count(l.server_name) AS servers FROM agent_dirs a
  LEFT JOIN links l ON a.scan_id = l.scan_id AND a.agent_dir = l.agent_dir GROUP BY ALL""")
def reach_counts(spark, sf):
    return built(spark, sf).reach


@query("reach_scopes", f"""{ENTITIES}, asked AS (
    SELECT scan_id, 'below ' || agent_dir AS scope FROM agent_dirs
    UNION ALL SELECT a.scan_id, 'marker ' || m FROM agent_dirs a, markers WHERE contains(agent_dir, m)
    UNION ALL SELECT a.scan_id, 'at ' || e.dir FROM agent_dirs a JOIN (SELECT DISTINCT scan_id, dir FROM entries) e
      ON a.scan_id = e.scan_id AND starts_with(a.agent_dir, e.dir)),
  offered AS (
    SELECT DISTINCT scan_id, 'at ' || dir AS scope, server_name FROM entries
    UNION SELECT scan_id, 'marker ' || m, server_name FROM entries, markers WHERE contains(dir, m)
    UNION SELECT a.scan_id, 'below ' || a.agent_dir, server_name FROM agent_dirs a JOIN entries e
      ON a.scan_id = e.scan_id AND starts_with(e.dir, a.agent_dir) AND e.dir <> a.agent_dir)
  SELECT scan_id, scope, CAST(sum(d) AS BIGINT) AS directories, CAST(sum(s) AS BIGINT) AS servers FROM (
    SELECT scan_id, scope, 1 AS d, 0 AS s FROM asked UNION ALL SELECT scan_id, scope, 0, 1 FROM offered) GROUP BY ALL""")
def reach_scopes(spark, sf):
    """The two narrow tables behind the links, by scope."""
    scopes = built(spark, sf).scopes
    both = scopes.directories.select("scan_id", "scope", F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(
        scopes.servers.select("scan_id", "scope", F.lit(0).alias("d"), F.lit(1).alias("s")))
    return both.groupBy("scan_id", "scope").agg(F.sum("d").alias("directories"), F.sum("s").alias("servers"))


@query("dependent_agents", f"""{ENTITIES} SELECT DISTINCT l.scan_id, l.server_name, a.id AS agent_id FROM links l
  JOIN agents a ON a.scan_id = l.scan_id AND a.dir = l.agent_dir""")
def dependents(spark, sf):
    return built(spark, sf).dependents


def _perm_sql(column):
    rows = " ".join(f"WHEN {quote(c)} THEN {str_list(p)}" for c, p in L.CAPABILITY_PERMISSIONS.items())
    return f"flatten(list_transform({column}, lambda c: CASE c {rows} ELSE {A.EMPTY} END))"


def _tool_sql(column, index):
    def spell(v):
        return (str_list(v) if v else A.EMPTY) if isinstance(v, list) else quote(v)
    rows = " ".join(f"WHEN {quote(t)} THEN {spell(r[index])}" for t, r in L.TOOL_SKILLS.items())
    return f"CASE {column} {rows} END"


SKILLS_SQL = f"""
skill_rows AS (
  SELECT scan_id, entity_name AS name, 0 AS phase, detector_rank, path, rule_order, 0 AS sub, '' AS tie, dir, 'file' AS kind,
    'Local Function' AS type, 'Local Process' AS env, coalesce(nullif(regexp_extract(content, 'description: "([^"]*)"', 1), ''),
      'Reusable agent skill instructions') AS description, {_perm_sql('caps')} AS permissions,
    list_concat(CASE WHEN len(list_intersect(caps, ['shell_execution', 'code_execution'])) > 0 THEN ['shell'] ELSE {A.EMPTY} END,
      CASE WHEN list_contains(caps, 'container_runtime') THEN ['docker'] ELSE {A.EMPTY} END) AS binaries,
    CASE WHEN len(list_intersect(caps, ['external_api_calls', 'network_access'])) > 0 THEN 'HTTP' ELSE '' END AS apis
  FROM entity WHERE artifact_type = 'skill'
  UNION ALL SELECT scan_id, t, 0, detector_rank, path, rule_order, i, '', dir, 'tool', coalesce({_tool_sql('t', 0)}, 'Local Function'),
    coalesce({_tool_sql('t', 1)}, 'Local Process'), coalesce({_tool_sql('t', 3)}, 'Provides ' || replace(t, '_', ' ') || ' functionality'),
    coalesce({_tool_sql('t', 4)}, {A.EMPTY}), coalesce({_tool_sql('t', 2)}, {A.EMPTY}), ''
  FROM (SELECT *, unnest(declared_tools) AS t, generate_subscripts(declared_tools, 1) AS i FROM entity)
  UNION ALL SELECT e.scan_id, string_split(e.value->>'$.command', '/')[-1], 1, 0, e.path, 0, 0, e.server_name, e.dir, 'command',
    'CLI Tool', 'Local Process', 'Executes MCP server via: ' || m.command_line, ['Shell execution'], [e.value->>'$.command'], ''
  FROM entries e JOIN srv_commands m ON e.scan_id = m.scan_id AND e.path = m.path AND e.server_name = m.server_name
  WHERE e.value->>'$.command' IS NOT NULL
),
skills AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, name ORDER BY phase, detector_rank, path, rule_order, sub, tie) AS n
  FROM skill_rows) WHERE n = 1)"""
# commands of every entry, not only of the first per name
ALL_COMMANDS_SQL = f"""
all_args AS (SELECT scan_id, path, server_name, unnest(a) AS arg, generate_subscripts(a, 1) AS i FROM (
  SELECT *, json_extract_string(value, '$.args[*]') AS a FROM entries)),
all_marks AS (SELECT *, CASE WHEN starts_with(arg, '-') THEN instr(arg, '=') > 2 ELSE instr(arg, '=') > 1 END AS assigned,
  left(arg, instr(arg, '=') - 1) AS key FROM all_args),
all_bare AS (SELECT *, NOT assigned AND NOT contains(lower(arg), 'bearer ') AND {_secret('arg')} AS bare FROM all_marks),
all_out AS (SELECT scan_id, path, server_name, i, CASE
    WHEN lag(bare) OVER (PARTITION BY scan_id, path, server_name ORDER BY i) THEN 'REDACTED'
    WHEN assigned AND {_secret('key')} THEN key || '=REDACTED' WHEN assigned THEN arg
    WHEN contains(lower(arg), 'bearer ') THEN 'REDACTED' ELSE arg END AS shown FROM all_bare),
srv_commands AS (SELECT e.scan_id, e.path, e.server_name, concat_ws(' ', coalesce(e.value->>'$.command', ''),
    string_agg(o.shown, ' ' ORDER BY o.i)) AS command_line FROM entries e LEFT JOIN all_out o
  ON e.scan_id = o.scan_id AND e.path = o.path AND e.server_name = o.server_name GROUP BY e.scan_id, e.path, e.server_name, e.value)"""
SKILLS = f"{ENTITIES}, {ALL_COMMANDS_SQL}, {SKILLS_SQL}"


@query("skill_records", f"""{SKILLS}, {REPOS_SQL}, src AS (SELECT s.scan_id, s.name, max_by(struct_pack(remote := r.remote, branch := r.branch,
      rel := CASE WHEN s.dir = r.dir THEN '' ELSE substr(s.dir, length(r.dir) + 2) END), length(r.dir)) AS m
    FROM skills s JOIN repos r ON s.scan_id = r.scan_id AND (s.dir = r.dir OR starts_with(s.dir, r.dir || '/'))
    WHERE kind = 'file' GROUP BY ALL)
  SELECT k.scan_id, k.name, kind, type, env AS environment, description,
    {S.joined(S.distinct('permissions'))} AS permissions, {S.joined('binaries')} AS binaries, apis,
    CASE WHEN kind = 'file' THEN 'A' ELSE 'pending' END AS grade,
    CASE WHEN kind = 'file' THEN 'Trusted' ELSE 'Conditional' END AS trust,
    CASE WHEN m.remote IS NULL OR m.remote = 'unknown' THEN '' WHEN contains(m.remote, 'github.com')
      THEN m.remote || '@' || m.branch || '/' || m.rel ELSE m.remote END AS source
  FROM skills k LEFT JOIN src s ON s.scan_id = k.scan_id AND s.name = k.name""")
def skill_records(spark, sf):
    s = built(spark, sf).skills
    d = F.col("detected_source")
    source = (F.when(d["status"] == "gitHub", F.concat(d["repo_url"], F.lit("@"), d["branch"], F.lit("/"), d["path"]))
              .when(d.isNotNull(), d["remote_url"]).otherwise(""))
    return s.select("scan_id", "name", "kind", "type", "environment", "description", joined("permissions").alias("permissions"),
                    joined("binaries").alias("binaries"), joined("apis").alias("apis"), "grade", "trust", source.alias("source"))


@query("skill_consumers", f"""{SKILLS}, tools AS (SELECT scan_id, id, unnest(declared_tools) AS t FROM agents
    UNION SELECT a.scan_id, a.id, l.server_name FROM agents a JOIN links l ON a.scan_id = l.scan_id AND a.dir = l.agent_dir)
  SELECT DISTINCT s.scan_id, s.name AS skill_name, t.id AS agent_id FROM skills s JOIN tools t ON t.scan_id = s.scan_id AND t.t = s.name
  WHERE kind <> 'file' UNION SELECT s.scan_id, s.name, a.id FROM skills s JOIN agents a ON a.scan_id = s.scan_id AND a.path = s.path WHERE kind = 'file'""")
def consumers(spark, sf):
    return built(spark, sf).consumers.select("scan_id", "skill_name", "agent_id")


@query("skill_grades", """WITH f AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 20 = 0 THEN 'critical' ELSE 'info' END
    WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'high' ELSE 'info' END WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity FROM orders),
  c AS (SELECT o_custkey, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h,
    count(*) FILTER (WHERE severity = 'medium') AS m, count(*) FILTER (WHERE severity = 'low') AS l FROM f GROUP BY o_custkey),
  g AS (SELECT *, CASE WHEN c > 0 OR h >= 3 THEN 'F' WHEN h > 0 OR m >= 3 THEN 'C' WHEN m > 0 OR l >= 4 THEN 'B' ELSE 'A' END AS grade FROM c)
  SELECT o_custkey, CAST(c AS BIGINT) AS critical, CAST(h AS BIGINT) AS high, CAST(m AS BIGINT) AS medium, CAST(l AS BIGINT) AS low, grade,
    CASE grade WHEN 'A' THEN 'Trusted' WHEN 'B' THEN 'Conditional' ELSE 'Untrusted' END AS trust FROM g""")
def skill_grades(spark, sf):
    return K.grade_skills(order_findings(spark, sf), "o_custkey")


def order_findings(spark, sf):
    severity = F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 20 = 0 THEN 'critical' ELSE 'info' END
      WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'high' ELSE 'info' END WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END""")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", severity.alias("severity"))


@query("front_matter_description", f"""WITH {FILES_SQL} SELECT path, nullif(regexp_extract(content, '\\A---\\nname: skill\\ndescription: "([^"]*)"', 1), '') AS description
  FROM files WHERE lower(name) = 'skill.md'""")
def descriptions(spark, sf):
    from riskledger.functions.text import front_matter_description
    df = files(spark, sf).where(F.lower(F.substring_index("path", "/", -1)) == "skill.md")
    return df.select("path", front_matter_description(F.col("content")).alias("description"))


@query("nearest_repository", f"""WITH {FILES_SQL}, {REPOS_SQL} SELECT f.path, max_by(r.dir, length(r.dir)) AS repo_dir, max_by(r.remote, length(r.dir)) AS remote
  FROM files f LEFT JOIN repos r ON f.scan_id = r.scan_id AND (f.dir = r.dir OR starts_with(f.dir, r.dir || '/')) GROUP BY f.path""")
def nearest_repository(spark, sf):
    from riskledger.functions.urls import sanitize_remote
    from riskledger.operators.corpus import with_path_parts
    df = links.nearest_repo(with_path_parts(files(spark, sf)).select("scan_id", "path", "dir"), repos(spark, sf))
    return df.select("path", "repo_dir", F.when(F.col("remote").isNotNull(), sanitize_remote(F.col("remote"))).alias("remote"))


APPS_SQL = """
members AS (SELECT c.scan_id, c.dir, a.id AS agent_id, a.name AS agent_name, a.classification, a.tool_count,
    row_number() OVER (PARTITION BY c.scan_id, c.dir ORDER BY sha256(a.scan_id || '/' || a.path)) AS step
  FROM (SELECT DISTINCT scan_id, dir FROM entity WHERE starts_with(artifact_type, 'container_')) c
  JOIN agents_n a ON a.scan_id = c.scan_id AND starts_with(a.path, c.dir)),
local AS (SELECT scan_id, dir, count(*) AS n, lower(string_agg(DISTINCT classification, ', ' ORDER BY classification)) AS classes FROM members GROUP BY ALL),
apps AS (
  SELECT e.*, coalesce(l.n, 0) AS agent_count, classes, CASE WHEN name = 'Dockerfile' THEN 'Container image definition'
      ELSE 'Service orchestration configuration' END AS lab,
    CASE WHEN len(list_filter(signals, lambda s: contains(s, 'langchain') OR contains(s, 'langgraph'))) > 0 THEN 'LangGraph' ELSE 'Custom' END AS framework,
    CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk
  FROM entity e LEFT JOIN local l ON e.scan_id = l.scan_id AND e.dir = l.dir
  WHERE starts_with(artifact_type, 'container_') AND (l.n > 0 OR contains(content, 'langgraph')))"""


@query("agentic_apps", f"""{ENTITIES}, {APPS_SQL} SELECT entity_id AS id, entity_name AS name, framework, CAST(agent_count AS BIGINT) AS agent_count, risk,
  CASE WHEN verification_status IN ('critical', 'high') THEN 'Flagged' ELSE 'Unreviewed' END AS review_status,
  lab || ' for a ' || framework || ' workflow' || CASE WHEN agent_count > 0 THEN ' with ' || agent_count || ' agent(s) performing ' || classes || ' tasks' ELSE '' END AS description,
  array_to_string([lab || ' present', 'Risk score computed', CASE WHEN verification_status IN ('info', 'low') THEN 'Verification passed' END,
    CASE WHEN contains(content, 'langgraph') THEN 'Direct agentic content detected' END,
    CASE WHEN list_contains(signals, 'ai_artifact_proximity') THEN 'AI artifact proximity detected' END], '|') AS checks,
  risk || '-risk ' || lower(lab) || ' ''' || entity_name || '''. ' || CASE WHEN len(risk_reasons) = 0 THEN 'No specific risk drivers identified.'
    ELSE 'Key risk drivers: ' || array_to_string(risk_reasons, ', ') || '.' END AS risk_summary FROM apps""")
def agentic_apps(spark, sf):
    return built(spark, sf).apps.select("id", "name", "framework", "agent_count", "risk", "review_status", "description",
                                        joined("verification_checks").alias("checks"), "risk_summary")


@query("app_workflow", f"""{ENTITIES}, {APPS_SQL} SELECT scan_id, dir, CAST(step AS BIGINT) AS step, agent_name AS agent,
  'Execute ' || classification || ' tasks using ' || tool_count || ' tools' AS action FROM members""")
def workflow(spark, sf):
    return built(spark, sf).members.select("scan_id", "dir", "step", F.col("agent_name").alias("agent"),
                                           E.workflow_action(F.col("classification"), F.col("tool_count")).alias("action"))


def scan_rows(spark, sf):
    meta = F.to_json(F.struct(F.col("scan_id").alias("scanId"), F.col("root").alias("endpointHostname")))
    return files(spark, sf).select("scan_id", "root").distinct().select(
        "scan_id", meta.alias("scan_meta"), (F.col("scan_id") == "scan2").alias("host_security"))


def record_rows(spark, sf):
    return plan.records(built(spark, sf))


_SECTION_COUNTS = f"""sections AS (
  SELECT scan_id, 'prompts' AS section, count(*) AS n FROM entity WHERE artifact_type IN ('cursor_rules', 'prompt_config', 'agents_md') GROUP BY scan_id
  UNION ALL SELECT scan_id, 'agents', count(*) FROM agents GROUP BY scan_id
  UNION ALL SELECT scan_id, 'mcpServers', count(*) FROM srv GROUP BY scan_id
  UNION ALL SELECT scan_id, 'skills', count(*) FROM skills GROUP BY scan_id
  UNION ALL SELECT scan_id, 'agenticApps', count(*) FROM apps GROUP BY scan_id)"""


@query("payload_assembly", f"""{SKILLS}, {APPS_SQL}, {_SECTION_COUNTS} SELECT scan_id, section, CAST(n AS BIGINT) AS records FROM sections""")
def payload_assembly(spark, sf):
    doc = plan.payload(record_rows(spark, sf), scan_rows(spark, sf))
    sizes = F.array(*[F.struct(F.lit(s).alias("section"), F.json_array_length(F.get_json_object("payload", f"$.{s}")).alias("n"))
                      for s in plan.SECTIONS])
    return (doc.select("scan_id", F.explode(sizes).alias("s")).groupBy("scan_id", "s.section")
            .agg(F.sum("s.n").alias("records")))


@query("contract_conformance", f"{SERVERS} SELECT scan_id, 'mcpServers' AS section, server_name || '-' || left(sha256(path), 12) AS key, 'transport' AS field, transport AS value FROM srv WHERE transport NOT IN "
                               "('stdio', 'sse', 'streamable-http', 'unknown')")
def conformance(spark, sf):
    return plan.violations(record_rows(spark, sf))


@query("disclosure_categories", f"""{SKILLS}, {APPS_SQL}, {_SECTION_COUNTS},
  cats(category, need) AS (VALUES ('meta', ''), ('roots', ''), ('hostname', ''), ('version', ''), ('prompts', 'prompts'), ('skills', 'skills'),
    ('agents', 'agents'), ('apps', 'agenticApps'), ('commands', 'mcpServers'), ('tools', 'mcpServers'), ('logs', 'mcpServers'))
  SELECT s.scan_id, category, {A.lookup(L.DISCLOSURE_LABELS, 'category')} AS label FROM (SELECT DISTINCT scan_id FROM files) s, cats
    WHERE need = '' OR EXISTS (SELECT 1 FROM sections x WHERE x.scan_id = s.scan_id AND x.section = need)
  UNION ALL SELECT 'scan2', 'host_security', {quote(L.DISCLOSURE_LABELS['host_security'])}
  UNION ALL SELECT DISTINCT scan_id, 'dependents', {quote(L.DISCLOSURE_LABELS['dependents'])} FROM links
  UNION ALL SELECT DISTINCT scan_id, 'env', {quote(L.DISCLOSURE_LABELS['env'])} FROM srv WHERE contains(vt, '"env"')""")
def disclosure(spark, sf):
    return plan.disclosure(record_rows(spark, sf), built(spark, sf), scan_rows(spark, sf))


@query("disclosure_record_counts", f"""{SKILLS}, {APPS_SQL}, {_SECTION_COUNTS} SELECT scan_id,
  CAST(sum(n) FILTER (WHERE section <> 'mcpServers') AS BIGINT) AS artifact_records, CAST(sum(n) FILTER (WHERE section = 'mcpServers') AS BIGINT) AS server_records
  FROM sections GROUP BY scan_id""")
def record_counts(spark, sf):
    return plan.disclosure_counts(record_rows(spark, sf))


@query("report_round_trip", f"""{SKILLS}, {APPS_SQL},
  rows AS (SELECT scan_id, 'prompts' AS section, entity_id AS id, entity_name AS name, path AS place FROM entity WHERE artifact_type IN ('cursor_rules', 'prompt_config', 'agents_md')
    UNION ALL SELECT scan_id, 'agents', id, name, path FROM agents
    UNION ALL SELECT scan_id, 'mcpServers', server_name || '-' || left(sha256(path), 12), server_name, NULL FROM srv
    UNION ALL SELECT scan_id, 'skills', NULL, name, NULL FROM skills
    UNION ALL SELECT scan_id, 'agenticApps', entity_id, entity_name, path FROM apps)
  SELECT DISTINCT scan_id, section, CASE WHEN section <> 'skills' THEN id END AS id, name, place FROM rows""")
def report_round_trip(spark, sf):
    """Documents written as JSON and read back with the whole schema."""
    from fleet_queries.changes import _folder
    from riskledger.sources import files as src
    folder = _folder(spark)
    src.write_payloads(plan.payload(record_rows(spark, sf), scan_rows(spark, sf)), folder)
    back = src.read_reports(spark, folder)
    none = F.lit(None).cast("string")

    def rows_of(section):
        return F.transform(section, lambda r: F.struct(
            F.lit(section).alias("section"), (none if section == "skills" else r["id"]).alias("id"), r["name"].alias("name"),
            (r["sourceFilePath"] if section in ("prompts", "agents", "agenticApps") else none).alias("place")))
    listed = F.concat(*[rows_of(s) for s in plan.SECTIONS])
    return back.select(F.col("scanMeta.scanId").alias("scan_id"), F.inline(listed)).distinct()
