"""SQL spelling of the whole scan over the derived files (for the side-by-side checks)."""

from fleet_queries import sqltext as S
from fleet_queries.corpus import FILES_SQL
from fleet_queries.registry import quote, str_list
from riskledger.catalog import labels as L, names as N, patterns as P, rules as R, weights as W
from riskledger.functions.regex import to_re2

EMPTY = "CAST([] AS VARCHAR[])"


def values(rows, columns):
    body = ", ".join("(" + ", ".join(
        str_list(v) if isinstance(v, list) and v else EMPTY if isinstance(v, list)
        else quote(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(columns)}))"


def lookup(mapping, column, default="NULL"):
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _rules_sql():
    rows = []
    for i, r in enumerate(R.BUILTIN_RULES):
        globs = [f.lower() for f in r["match"]["filenames"] if "*" in f]
        exact = sorted({f.lower() for f in r["match"]["filenames"] if "*" not in f})
        rows.append((i, r["detector"]["name"], r["detector"]["artifact_type"], r["match"]["confidence"], exact,
                     globs, r["keywords"]["keywords"], r["keywords"]["boost_confidence"],
                     r["deep_keywords"]["keywords"]))
    return values(rows, ["rule_rank", "rule_name", "rtype", "conf", "exact", "globs", "kws", "boost", "deeps"])


def _kw(column, prefix):
    return (f"list_transform(list_filter({column}, lambda w: contains(lower(content), lower(w))), "
            f"lambda w: '{prefix}:' || w)")


def _toks(words, low="lower(content)", prefix=""):
    lst = f"list_filter({str_list(words)}, lambda w: contains({low}, w))"
    return f"list_transform({lst}, lambda w: {quote(prefix)} || w)" if prefix else lst


SIGNALS = S.signal_ctes("files", "file_id", "content")

# One line per finding of a source line: (family, signal, ordinal, summary, condition over `line`)


def _line_rules():
    out = []
    for signal, summary, expr, starts in P.SOURCE_CALL_PATTERNS:
        first = f"regexp_extract(line, {quote(to_re2(expr) + chr(92) + 's*(' + chr(92) + 'S?)')}, 1)"
        banned = ", ".join(quote(c) for c in starts)
        out.append(("dynamic_execution", signal, 0, quote(summary), f"({first} <> '' AND {first} NOT IN ({banned}))"))
    out.append(("network_context", "source:ssrf_private_ip", 0, quote(P.PRIVATE_IP_SUMMARY),
                f"({S.match('line', P.NETWORK_CALL)} AND ({S.match('line', P.PRIVATE_IP)} OR {S.match('line', P.LINK_LOCAL_IP)}))"))
    out.append(("network_context", "source:ssrf_internal_host", 0, quote(P.INTERNAL_HOST_SUMMARY),
                S.match("line", P.INTERNAL_HOST_CONTEXT)))
    for i, (summary, expr) in enumerate(P.SENSITIVE_PATH_PATTERNS):
        out.append(("sensitive_path", P.SENSITIVE_PATH_SIGNAL, i, quote(summary), S.match("line", expr)))
    named = f"list_filter({str_list(P.IDENTITY_FILES)}, lambda n: contains(lower(line), n))"
    out.append(("cognitive_file", "cognitive_tampering:file_target", 0,
                f"'Source targets agent identity file ' || {named}[1]",
                f"(len({named}) > 0 AND {S.match('line', P.TARGET_CALL)})"))
    return out


def _source_findings():
    parts = [f"SELECT file_id, scan_id, path, '{fam}' AS family, {quote(sig)} AS signal, n AS line, {o} AS ordinal, "
             f"{summary} AS summary FROM src_lines WHERE {cond}" for fam, sig, o, summary, cond in _line_rules()]
    named = f"list_filter({str_list(P.IDENTITY_FILES)}, lambda n: contains(lower(content), n))[1]"
    parts.append(
        f"""SELECT file_id, scan_id, path, 'cognitive_file', 'cognitive_tampering:file_write',
          1 + len(regexp_extract_all(left(lower(content), instr(lower(content), {named}) - 1), chr(10))), 0,
          'Source references and may write agent identity file ' || {named}
        FROM src_files WHERE is_source AND {named} IS NOT NULL AND {S.match('content', P.WRITE_CALL)}""")
    return " UNION ALL ".join(parts)


def _json_findings():
    parts = [f"""SELECT file_id, scan_id, path, 'json_secret' AS family, unnest(secret_signals) AS signal,
      CAST(NULL AS BIGINT) AS line, {quote(P.JSON_SECRET_SUMMARY)} AS summary
      FROM src_files JOIN sig USING (file_id) WHERE NOT is_source"""]
    for signal, family, summary, expr, _ in P.JSON_PATTERNS:
        before = f"regexp_extract(content, {quote('(?s)^(.*?)(?:' + to_re2(expr) + ')')}, 1)"
        parts.append(f"""SELECT file_id, scan_id, path, '{family}', {quote(signal)},
          1 + len(regexp_extract_all({before}, chr(10))), {quote(summary)}
          FROM src_files WHERE NOT is_source AND {S.match('content', expr)}""")
    return " UNION ALL ".join(parts)


FINDINGS_SQL = f"""
src_files AS (
  SELECT *, lower({S.ext_of('name')}) IN ({', '.join(quote(e) for e in N.SOURCE_EXTENSIONS)}) AS is_source
  FROM files WHERE is_source OR (lower({S.ext_of('name')}) = 'json'
    AND lower(name) NOT IN ({', '.join(quote(n) for n in N.JSON_SKIP_NAMES)}))
),
src_lines AS (
  SELECT file_id, scan_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS ls FROM src_files WHERE is_source)
),
src_found AS ({_source_findings()}),
src_first AS (
  SELECT scan_id, path, signal, min(struct_pack(line := line, ordinal := ordinal, family := family, summary := summary)) AS m
  FROM src_found GROUP BY ALL
),
findings AS (
  SELECT scan_id, path, m.family AS family, signal, CAST(m.line AS BIGINT) AS line, m.summary AS summary FROM src_first
  UNION ALL SELECT scan_id, path, family, signal, CAST(line AS BIGINT), summary FROM ({_json_findings()})
)"""

_CRYPTO = [(s, W.CRYPTO_WEIGHT) for s, _, _ in P.SECRET_PATTERNS if s.startswith(W.CRYPTO_PREFIX)]
_WEIGHT_ROWS = values(list(W.RISK_WEIGHTS.items()) + _CRYPTO, ["signal", "weight"])
_LOCAL_ROWS = values(list(W.LOCAL_WEIGHTS.items()) + _CRYPTO, ["signal", "weight"])

DETECT_SQL = f"""
rules AS {_rules_sql()},
content AS (SELECT f.*, {S.content_allowed('name')} AS content_ok, s.secret_signals, s.danger_signals
  FROM files f JOIN sig s USING (file_id)),
ruled AS (
  SELECT *, CASE WHEN list_contains(exact, lower(name)) THEN 0
    WHEN len(list_filter(globs, lambda g: lower(name) GLOB g)) > 0 THEN 2 END AS kind,
    CASE WHEN content_ok THEN {_kw('kws', 'keyword')} ELSE {EMPTY} END AS kwh,
    CASE WHEN content_ok THEN {_kw('deeps', 'deep_keyword')} ELSE {EMPTY} END AS dkh
  FROM content, rules WHERE kind IS NOT NULL
),
custom AS (
  SELECT file_id, 'custom_rules' AS detector, kind * 100000 + rule_rank AS rule_order, rule_name,
    rtype AS artifact_type,
    least(1.0, greatest(conf, CASE WHEN len(kwh) >= 1 THEN boost END, CASE WHEN len(dkh) >= 1 THEN 0.9 END)) AS confidence,
    list_concat(['filename_match:' || name], kwh, dkh,
      CASE WHEN content_ok THEN list_concat(secret_signals, danger_signals) ELSE {EMPTY} END) AS signals
  FROM ruled
),
near AS (SELECT DISTINCT scan_id, dir FROM files WHERE name IN ({', '.join(quote(n) for n in N.PROXIMITY_NAMES)})),
boxed AS (
  SELECT c.*, n.dir IS NOT NULL AS ai_near, {_toks(N.AI_TOKENS, prefix='ai_token:')} AS ai,
    len({_toks(N.AGENTIC_TOKENS)}) > 0 AS agentic
  FROM content c LEFT JOIN near n ON c.scan_id = n.scan_id AND c.dir = n.dir
  WHERE name IN ({', '.join(quote(n) for n in N.CONTAINER_NAMES)})
),
box AS (
  SELECT file_id, 'containers' AS detector, 0 AS rule_order, CAST(NULL AS VARCHAR) AS rule_name,
    CASE WHEN len(ai) > 0 THEN 'container_config' ELSE 'container_candidate' END AS artifact_type,
    CASE WHEN len(ai) > 0 THEN 0.8 WHEN ai_near THEN 0.55 ELSE 0.4 END AS confidence,
    list_concat(CASE WHEN ai_near THEN ['ai_artifact_proximity'] ELSE {EMPTY} END, ai, secret_signals, danger_signals) AS signals
  FROM boxed
),
served AS (
  SELECT *, {_toks(N.EXECUTION_TOKENS)} AS ex, {_toks(N.SHELL_TOKENS)} AS sh, {_toks(N.CREDENTIAL_TOKENS)} AS cr,
    regexp_extract_all(content, {quote(P.HTTP_URL)}) AS endpoints,
    list_sort(json_keys(content::JSON, '$.mcpServers')) AS servers
  FROM content WHERE name IN ({', '.join(quote(n) for n in N.MCP_NAMES)})
),
mcp AS (
  SELECT file_id, 'mcp_configs' AS detector, 0 AS rule_order, CAST(NULL AS VARCHAR) AS rule_name,
    'mcp_config' AS artifact_type, 0.85 AS confidence,
    list_concat({S.compact(["CASE WHEN len(ex) > 0 THEN 'execution_tokens_present' END",
                            "CASE WHEN len(sh) > 0 THEN 'shell_access_detected' END",
                            "CASE WHEN len(cr) > 0 THEN 'credential_references' END"])}, secret_signals) AS signals
  FROM served
),
surface AS (
  SELECT scan_id, list_sort(list(DISTINCT signal)) AS signals FROM findings GROUP BY scan_id
),
detected AS (
  SELECT a.*, f.scan_id, f.path, f.name, f.dir, f.origin, f.size_bytes, f.modified_at, f.declared_tools, f.content,
    {S.content_allowed('f.name')} AS content_ok, coalesce(s.endpoints, {EMPTY}) AS api_endpoints
  FROM (SELECT * FROM custom UNION ALL SELECT * FROM box UNION ALL SELECT * FROM mcp) a
  JOIN files f USING (file_id) LEFT JOIN served s USING (file_id)
  UNION ALL
  SELECT NULL, 'source_risks', 0, NULL, 'source_risk_surface', 0.65, signals, scan_id, '/home/u' || right(scan_id, 1),
    NULL, NULL, 'project', NULL, NULL, {EMPTY}, NULL, FALSE, {EMPTY} FROM surface
)"""

SCORE_SQL = f"""
weights AS {_WEIGHT_ROWS},
local_weights AS {_LOCAL_ROWS},
keyed AS (SELECT row_number() OVER () AS art, * FROM detected),
flat AS (
  SELECT art, declared_tools, unnest(signals) AS signal, generate_subscripts(signals, 1) AS pos,
    len(list_filter(signals, lambda s: starts_with(s, 'secret:'))) > 0 AS structured FROM keyed
),
weighed AS (
  SELECT f.art, pos, f.signal,
    CASE WHEN list_contains(declared_tools, {lookup(W.DECLARED_TOOL, 'f.signal')}) THEN CAST(floor(w.weight * 0.5) AS BIGINT)
      ELSE w.weight END AS weight
  FROM flat f JOIN weights w ON f.signal = w.signal
  WHERE NOT (structured AND f.signal = 'credential_exposure_signal')
),
totals AS (
  SELECT art, sum(weight) AS total,
    list(signal || ' (+' || weight || ')' ORDER BY weight DESC, pos)[1:2] AS risk_reasons
  FROM weighed GROUP BY art
),
local_totals AS (
  SELECT f.art, sum(w.weight) AS total FROM flat f JOIN local_weights w ON f.signal = w.signal
  WHERE NOT (structured AND f.signal = 'credential_exposure_signal') GROUP BY f.art
),
scored AS (
  SELECT k.*, CAST(least(100, {lookup(W.TYPE_BASE, 'artifact_type', 5)} + coalesce(t.total, 0)) AS BIGINT) AS risk_score,
    CAST(least(100, {lookup(W.LOCAL_TYPE_BASE, 'artifact_type', 1)} + coalesce(l.total, 0)) AS BIGINT) AS local_score,
    coalesce(t.risk_reasons, {EMPTY}) AS risk_reasons
  FROM keyed k LEFT JOIN totals t ON k.art = t.art LEFT JOIN local_totals l ON k.art = l.art
),
graded AS (
  SELECT *, CASE WHEN risk_score >= 90 THEN 5 WHEN risk_score >= 70 THEN 4 WHEN risk_score >= 40 THEN 3
      WHEN risk_score >= 10 THEN 2 ELSE 1 END AS band,
    len(list_filter(signals, lambda s: starts_with(s, 'dangerous_keyword:'))) > 0 AS dk,
    list_contains(signals, {quote(P.COMBO_SIGNAL)}) AS combo,
    len(declared_tools) > 0 OR len(api_endpoints) > 0 AS governed,
    CASE WHEN list_contains(signals, 'credential_exposure_signal') THEN 5
      WHEN dk AND governed THEN greatest(band, 3) WHEN dk THEN greatest(band, 4)
      WHEN combo THEN greatest(band, 3) ELSE band END AS srank,
    ['info', 'low', 'medium', 'high', 'critical'][srank] AS verification_status
  FROM scored
),
scoped AS (
  SELECT *, CASE WHEN starts_with(artifact_type, 'container_') THEN 'container'
      WHEN len(list_intersect(string_split(lower(path), '/'), {str_list(N.DOC_PARTS)})) > 0 THEN 'docs'
      WHEN origin = 'host' THEN 'host' ELSE 'project' END AS artifact_scope
  FROM graded
),
artifacts AS (
  SELECT *, CASE WHEN artifact_type IN ('cursor_rules', 'agents_md', 'container_config') THEN TRUE
      WHEN artifact_type IN ('source_risk_surface', 'container_candidate') THEN FALSE
      WHEN artifact_type = 'prompt_config' AND artifact_scope = 'docs' THEN FALSE
      WHEN artifact_type = 'prompt_config' THEN
        len(list_filter(signals, lambda s: starts_with(s, 'keyword:'))) > 0 OR confidence >= 0.85
      ELSE confidence >= 0.6 END AS registry_eligible,
    CASE WHEN artifact_type = 'source_risk_surface' OR verification_status IN ('critical', 'high')
      OR len(list_intersect(signals, {str_list(L.LOCAL_ANALYSIS_SIGNALS)})) > 0
      OR len(list_filter(signals, lambda s: starts_with(s, 'secret:') OR starts_with(s, 'ssrf:')
        OR starts_with(s, 'cognitive_tampering:'))) > 0 THEN 'local' ELSE 'server_candidate' END AS analysis_origin,
    CASE WHEN file_id IS NOT NULL THEN sha256('{{"artifact_content":"' || sha256(content) || '","artifact_type":"'
      || artifact_type || '","version":"v1"}}') END AS artifact_hash,
    list_sort(list_distinct(list_filter(list_transform(signals, lambda s: {lookup(L.CAPABILITY, 's')}), lambda c: c IS NOT NULL))) AS caps,
    {lookup(N.DETECTOR_RANK, 'detector')} AS detector_rank
  FROM scoped
)"""

FINDINGS = f"WITH {FILES_SQL}, {SIGNALS}, {FINDINGS_SQL}"
DETECTED = f"{FINDINGS}, {DETECT_SQL}"
ARTIFACTS = f"{DETECTED}, {SCORE_SQL}"
