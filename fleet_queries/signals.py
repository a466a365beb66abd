"""Text signals over the derived files and over the raw text tables."""

from pyspark.sql import functions as F

from fleet_queries import sqltext as S
from fleet_queries.corpus import FILES_SQL, files
from fleet_queries.registry import query, quote, spread, table
from riskledger.catalog import names, patterns as P
from riskledger.functions import signals as G, urls as U

SIG = S.signal_ctes("files", "file_id", "content")


def joined(column):
    return F.array_join(column, "|")


def _list_query(name, column, families):
    @query(name, f"WITH {FILES_SQL}, {SIG} SELECT file_id, {S.joined(column)} AS signals "
                 f"FROM sig WHERE len({column}) > 0")
    def run(spark, sf):
        df = files(spark, sf).select("file_id", F.col("content").alias("text"))
        return (G.with_signals(df, families=families).where(F.size(column) > 0)
                .select("file_id", joined(column).alias("signals")))


_list_query("secret_scan", "secret_signals", ["secret"])
_list_query("dangerous_keywords_and_combo", "dangerous_signals", ["dangerous"])
_list_query("ssrf_scan", "ssrf_signals", ["ssrf"])
_list_query("tampering_scan_with_base64", "tampering_signals", ["tampering"])
_list_query("combined_danger_scan", "danger_signals", ["dangerous", "ssrf", "tampering"])


@query("legacy_secret_flag", f"""WITH {FILES_SQL} SELECT scan_id, count(*) AS files,
  CAST(count(*) FILTER (WHERE {S.any_match('content', [e for _, e, _ in P.LEGACY_SECRET_PATTERNS])}) AS BIGINT)
  AS flagged FROM files GROUP BY scan_id""")
def legacy_flag(spark, sf):
    df = files(spark, sf).withColumn("fold", G.folded(F.col("content")))
    return df.groupBy("scan_id").agg(
        F.count("*").alias("files"),
        F.count_if(G.legacy_secret_flag("content", "fold")).alias("flagged"))


@query("shell_network_fs_combo", f"""WITH {FILES_SQL}, {SIG} SELECT f.scan_id, f.name, count(*) AS hits
  FROM sig s JOIN files f USING (file_id)
  WHERE list_contains(dangerous_signals, {quote(P.COMBO_SIGNAL)}) GROUP BY ALL""")
def combo(spark, sf):
    return (files(spark, sf).withColumn("fold", G.folded(F.col("content"))).where(G.combo_hit("fold"))
            .groupBy("scan_id", F.substring_index("path", "/", -1).alias("name"))
            .agg(F.count("*").alias("hits")))


def _raw(name, table_name, key, group, text="text"):
    """Signal counts by a grouping column over a raw text table, whole texts."""
    sql = f"""WITH {S.signal_ctes(table_name, key, text)},
      marked AS (SELECT t.{group} AS grp, s.* FROM sig s JOIN {table_name} t ON t.{key} = s.{key}),
      flat AS (SELECT grp, unnest(list_concat(secret_signals, danger_signals)) AS signal FROM marked)
      SELECT CAST(grp AS VARCHAR) AS grp, signal, count(*) AS texts FROM flat GROUP BY ALL"""

    @query(name, sql)
    def run(spark, sf):
        df = G.with_signals(spread(table(spark, sf, table_name), key), text)
        return (df.select(F.col(group).cast("string").alias("grp"),
                          F.explode(F.concat("secret_signals", "danger_signals")).alias("signal"))
                .groupBy("grp", "signal").agg(F.count("*").alias("texts")))


_raw("document_signals_by_source", "documents", "doc_id", "source")
_raw("page_signals", "pages", "page_id", "page_id", "html")


@query("planted_turn_signals_by_role", f"""WITH turns AS (
    SELECT conv_id * 1000 + turn AS turn_id, role,
      CASE WHEN (conv_id + turn) % 3 = 0 THEN text || ' disregard all previous' ELSE text END AS body2
    FROM conversations),
  {S.signal_ctes('turns', 'turn_id', 'body2')}
  SELECT role, signal, count(*) AS turns FROM (
    SELECT t.role, unnest(list_concat(s.secret_signals, s.danger_signals)) AS signal FROM sig s JOIN turns t USING (turn_id)) GROUP BY ALL""")
def turn_signals(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("text", F.when(
        (F.col("conv_id") + F.col("turn")) % 3 == 0,
        F.concat("text", F.lit(" disregard all previous"))).otherwise(F.col("text")))
    return (G.with_signals(turns)
            .select("role", F.explode(F.concat("secret_signals", "danger_signals")).alias("signal"))
            .groupBy("role", "signal").agg(F.count("*").alias("turns")))


KEYWORDS = ["tools", "Permissions", "shell", "api", "the", "que"]


@query("keyword_scan", f"""WITH {FILES_SQL}, hits AS (
    SELECT file_id, list_transform(list_filter({S.words(KEYWORDS)}, lambda w: contains(lower(content), lower(w))),
      lambda w: 'kw:' || w) AS h FROM files)
  SELECT file_id, array_to_string(h, '|') AS signals, CAST(len(h) AS BIGINT) AS hits FROM hits WHERE len(h) > 0""")
def keyword_scan(spark, sf):
    words = F.array(*[F.lit(w) for w in KEYWORDS])
    df = files(spark, sf).select("file_id", G.keyword_signals(F.lower("content"), words, F.lit("kw")).alias("h"))
    return df.where(F.size("h") > 0).select(
        "file_id", joined("h").alias("signals"), F.size("h").cast("bigint").alias("hits"))


# a rule for each part, of pieces of texts: long ones, short ones and one that many texts hold
TERM_RULES_SQL = """r AS (SELECT p_partkey AS rule_rank, [substring(text, 11 + p_partkey % 40, 9), translate(substring(text, 60, 5), 'abcdefghij', 'ABCDEFGHIJ'),
      CASE WHEN p_partkey % 50 = 0 THEN 'ing' ELSE 'no such term ' || p_partkey END] AS terms, p_size / 100.0 AS confidence
    FROM part JOIN documents ON doc_id = p_partkey % 977)"""


@query("keyword_rules_by_term", f"""WITH {TERM_RULES_SQL}, each AS (
    SELECT rule_rank, confidence, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM r),
  low AS MATERIALIZED (SELECT DISTINCT lower(term) AS t FROM each WHERE term <> ''),
  texts AS MATERIALIZED (SELECT doc_id, lower(text) AS x FROM documents),
  met AS (SELECT doc_id, t FROM texts JOIN low ON contains(x, t)),
  h AS (SELECT doc_id, rule_rank, confidence, count(*) AS n, string_agg('kw:' || term, '|' ORDER BY i) AS signals
    FROM met JOIN each ON lower(term) = t GROUP BY ALL)
  SELECT doc_id, CAST(rule_rank AS BIGINT) AS rule_rank, CAST(CASE WHEN n >= 2 THEN greatest(confidence, 0.4) ELSE confidence END AS DOUBLE) AS confidence,
    signals FROM h""")
def keyword_rules_by_term(spark, sf):
    """One keyword rule for every part, tried on every text."""
    from riskledger.operators.rules import term_rules
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = table(spark, sf, "part").join(docs, F.col("doc_id") == F.col("p_partkey") % 977).selectExpr(
        "p_partkey as rule_rank", """array(substring(text, 11 + p_partkey % 40, 9), translate(substring(text, 60, 5), 'abcdefghij', 'ABCDEFGHIJ'),
          CASE WHEN p_partkey % 50 = 0 THEN 'ing' ELSE concat('no such term ', p_partkey) END) as terms""",
        "'kw' as prefix", "cast(p_size / 100.0 as double) as confidence", "0.4D as boost", "2 as threshold")
    found = term_rules(docs, ["doc_id"], rules)
    return found.select("doc_id", F.col("rule_rank").cast("bigint").alias("rule_rank"), "confidence", joined("signals").alias("signals"))


USER_REGEX = ['token = "[0-9a-f]{40}"', r"\$$", r"(?i)the\b"]


@query("user_regex_scan", f"""WITH hits AS (SELECT doc_id, {S.compact(
    [f"CASE WHEN {S.match('text', e)} THEN 'rx:' || {quote(e)} END" for e in USER_REGEX])} AS h FROM documents)
  SELECT doc_id, array_to_string(h, '|') AS signals FROM hits WHERE len(h) > 0""")
def user_regex(spark, sf):
    from riskledger.functions.regex import to_java
    exprs = F.array(*[F.lit(e) for e in USER_REGEX])
    jvm = F.array(*[F.lit(to_java(e)) for e in USER_REGEX])
    df = table(spark, sf, "documents").select(
        "doc_id", G.regex_signals(F.col("text"), exprs, jvm, F.lit("rx")).alias("h"))
    return df.where(F.size("h") > 0).select("doc_id", joined("h").alias("signals"))


def _tokens_sql(lst):
    return f"array_to_string(list_filter({S.words(lst)}, lambda w: contains(lower(content), w)), '|')"


@query("token_scan", f"""WITH {FILES_SQL} SELECT * FROM (SELECT file_id, {_tokens_sql(names.EXECUTION_TOKENS)}
   AS execution, {_tokens_sql(names.SHELL_TOKENS)} AS shell, {_tokens_sql(names.CREDENTIAL_TOKENS)} AS credential
   FROM files) WHERE execution || shell || credential <> ''""")
def token_scan(spark, sf):
    df = files(spark, sf).withColumn("low", F.lower("content"))
    df = G.computed_once(df, execution=joined(G.tokens_in("low", names.EXECUTION_TOKENS)),
                         shell=joined(G.tokens_in("low", names.SHELL_TOKENS)),
                         credential=joined(G.tokens_in("low", names.CREDENTIAL_TOKENS)))
    return df.select("file_id", "execution", "shell", "credential").where(F.concat("execution", "shell", "credential") != "")


@query("ai_token_scan", f"""WITH {FILES_SQL}, t AS (SELECT file_id,
    list_filter({S.words(names.AI_TOKENS)}, lambda w: contains(lower(content), w)) AS ai FROM files)
  SELECT file_id, array_to_string(list_transform(ai, lambda w: 'ai_token:' || w), '|') AS signals,
    len(list_intersect(ai, {S.words(names.AGENTIC_TOKENS)})) > 0 AS agentic FROM t WHERE len(ai) > 0""")
def ai_tokens(spark, sf):
    df = files(spark, sf).withColumn("low", F.lower("content"))
    df = G.computed_once(df, signals=joined(G.tokens_in("low", names.AI_TOKENS, "ai_token:")),
                         agentic=G.contains_any(F.col("low"), names.AGENTIC_TOKENS))
    return df.where("signals <> ''").select("file_id", "signals", "agentic")


@query("url_extraction", f"""SELECT page_id, url, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, {quote(P.HTTP_URL)})) AS url FROM pages) GROUP BY ALL""")
def url_extraction(spark, sf):
    return (table(spark, sf, "pages")
            .select("page_id", F.explode(G.urls(F.concat_ws(" ", "url", "html"), P.HTTP_URL)).alias("url"))
            .groupBy("page_id", "url").agg(F.count("*").alias("times")))


@query("websocket_and_log_urls", f"""WITH {FILES_SQL}, u AS (
    SELECT scan_id, 'ws' AS kind, unnest(regexp_extract_all(content, {quote(P.WS_URL)})) AS url FROM files
    UNION ALL SELECT scan_id, 'log', unnest(regexp_extract_all(content, {quote(P.HTTP_URL_LOG)})) FROM files)
  SELECT scan_id, kind, url, count(*) AS times FROM u GROUP BY ALL""")
def ws_urls(spark, sf):
    f = files(spark, sf)
    marked = lambda kind, expr: F.transform(G.urls(F.col("content"), expr), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))
    both = f.select("scan_id", F.inline(F.concat(marked("ws", P.WS_URL), marked("log", P.HTTP_URL_LOG))))
    return both.groupBy("scan_id", "kind", "url").agg(F.count("*").alias("times"))


@query("prompt_surfaces", f"""WITH {FILES_SQL} SELECT file_id,
    {S.any_contains('lower(content)', ['{{', '{%', '${'])} AS template,
    {S.any_contains('lower(content)', ['user_input', 'user_message'])} AS user_input,
    CASE WHEN contains(content, '$') THEN '$' WHEN contains(content, 'process.env.') THEN 'process.env.'
      WHEN contains(content, 'os.environ') THEN 'os.environ' END AS env_marker,
    array_to_string(regexp_extract_all(content, {quote(P.ENV_VAR)}, 1), '|') AS env_names FROM files""")
def prompt_surfaces(spark, sf):
    c = F.col("content")
    return files(spark, sf).select(
        "file_id", G.template_surface(c).alias("template"), G.user_input_surface(c).alias("user_input"),
        G.env_marker(c).alias("env_marker"), joined(G.env_names(c)).alias("env_names"))


@query("noisy_url_filter", f"""WITH {FILES_SQL}, u AS (
    SELECT scan_id, unnest(regexp_extract_all(content, {quote(P.HTTP_URL_LOG)})) AS url FROM files)
  SELECT scan_id, url, count(*) AS times FROM u
  WHERE NOT {S.any_contains('lower(url)', names.NOISY_URL_PARTS)} GROUP BY ALL""")
def noisy(spark, sf):
    return (files(spark, sf)
            .select("scan_id", F.explode(G.urls(F.col("content"), P.HTTP_URL_LOG)).alias("url"))
            .where(~U.is_noisy_url(F.col("url"))).groupBy("scan_id", "url").agg(F.count("*").alias("times")))
