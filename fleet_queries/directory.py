"""Catalog queries; parts, orders and line items stand in for skills, findings and scanner runs."""

from pyspark.sql import functions as F

from fleet_queries.contract import order_findings
from fleet_queries.registry import query, table
from riskledger.operators import catalog as C

CATALOG_SQL = """catalog AS (SELECT 'part-' || p_partkey AS slug, p_name AS name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type || ' tool by ' || p_brand END AS description, p_brand AS author, p_type AS category,
  ['A', 'B', 'C', 'F'][p_partkey % 4 + 1] AS grade, CASE WHEN p_partkey % 3 = 0 THEN 'MIT' END AS license,
  CAST(p_retailprice * 10 AS BIGINT) AS downloads, ['python', 'rust', 'go'][p_partkey % 3 + 1] AS language,
  CASE WHEN p_size % 2 = 0 THEN ['cursor', 'copilot'] ELSE ['claude'] END AS agents, p_size AS stars, p_partkey % 100 AS leaderboard_rank,
  p_size % 4 AS aggregators, p_partkey % 7 = 0 AS official FROM part)"""


def catalog(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('part-', p_partkey) slug", "p_name name",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_type, ' tool by ', p_brand) END description", "p_brand author",
        "p_type category", "element_at(array('A', 'B', 'C', 'F'), cast(p_partkey % 4 + 1 as int)) grade",
        "CASE WHEN p_partkey % 3 = 0 THEN 'MIT' END license", "cast(round(p_retailprice * 10) as bigint) downloads",
        "element_at(array('python', 'rust', 'go'), cast(p_partkey % 3 + 1 as int)) language",
        "CASE WHEN p_size % 2 = 0 THEN array('cursor', 'copilot') ELSE array('claude') END agents", "p_size stars",
        "p_partkey % 100 leaderboard_rank", "p_size % 4 aggregators", "p_partkey % 7 = 0 official")


CATALOG_SQL = CATALOG_SQL.replace("CAST(p_retailprice * 10 AS BIGINT)", "CAST(round(p_retailprice * 10) AS BIGINT)")
ROWS = "slug, name, downloads"


@query("catalog_search", f"""WITH {CATALOG_SQL} SELECT {ROWS} FROM catalog WHERE contains(lower(slug), 'ring') OR contains(lower(name), 'ring')
  OR contains(lower(coalesce(description, '')), 'ring')""")
def search(spark, sf):
    return C.search(catalog(spark, sf), "Ring").select("slug", "name", "downloads")


@query("catalog_facets", f"""WITH {CATALOG_SQL} SELECT {ROWS} FROM catalog WHERE language IN ('python', 'go') AND list_contains(agents, 'cursor')
  AND stars >= 10 AND leaderboard_rank <= 60 AND aggregators >= 1 AND NOT official""")
def facets(spark, sf):
    return C.facets(catalog(spark, sf), ["python", "go"], ["cursor"], {
        "stars": 10, "skillsShLeaderboardRank": 60, "numberOfAggregators": 1,
        "officialClaudeMarketplace": False}).select("slug", "name", "downloads")


@query("catalog_sorted_page", f"""WITH {CATALOG_SQL}, t AS (SELECT count(*) AS total FROM catalog)
  SELECT slug, name, grade, total, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages, CAST(2 AS BIGINT) AS page FROM
    (SELECT * FROM catalog ORDER BY grade DESC, slug LIMIT 20 OFFSET 20), t""")
def sorted_page(spark, sf):
    return C.page(catalog(spark, sf), "rating", number=2).select(
        "slug", "name", "grade", "total", F.col("total_pages").cast("bigint").alias("total_pages"),
        F.col("page").cast("bigint").alias("page"))


@query("catalog_late_page", """WITH t AS (SELECT count(*) AS total FROM orders)
  SELECT 'order-' || o_orderkey AS slug, total, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages, CAST(60 AS BIGINT) AS page FROM
    (SELECT * FROM orders ORDER BY o_custkey % 5 DESC, 'order-' || o_orderkey LIMIT 20 OFFSET 1180), t""")
def late_page(spark, sf):
    """A page far back, read by position from a stored listing."""
    from fleet_queries.changes import _folder
    folder = _folder(spark)
    rows = table(spark, sf, "orders").selectExpr("concat('order-', o_orderkey) slug", "o_custkey % 5 as downloads")
    C.write_sorted(rows, folder, "downloads", ranges=16)
    return C.page_of(spark.read.parquet(folder), "downloads", number=60).select(
        "slug", "total", F.col("total_pages").cast("bigint").alias("total_pages"), F.col("page").cast("bigint").alias("page"))


@query("catalog_ranked_search", """WITH w AS (SELECT doc_id AS slug, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
  i AS (SELECT slug, len(w) AS length, unnest(w) AS term FROM w),
  p AS (SELECT slug, length, term, count(*) AS times FROM i WHERE term IN ('ring', 'tion', 'the', 'que') GROUP BY ALL),
  h AS (SELECT term, count(*) AS held FROM p GROUP BY ALL)
  SELECT slug, round(sum(ln(1 + (n - held + 0.5) / (held + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM p JOIN h USING (term), n GROUP BY slug ORDER BY score DESC, slug LIMIT 50""")
def ranked_search(spark, sf):
    """BM25 over the texts of the documents as a catalog, from an index that is stored and updated."""
    from fleet_queries.changes import _folder
    folder = _folder(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("slug"), "text")
    stale = docs.withColumn("text", F.when(F.col("slug") % 10 == 0, F.lit("an older text")).otherwise(F.col("text")))
    C.search_index(stale, ["text"]).write.parquet(f"{folder}/old")
    old = spark.read.parquet(f"{folder}/old")
    C.update_index(old, docs.where("slug % 10 = 0"), ["text"]).write.parquet(f"{folder}/new")
    return C.ranked(spark.read.parquet(f"{folder}/new"), "The ring? tion QUE", 50).select("slug", F.round("score", 6).alias("score"))


@query("catalog_trending", f"WITH {CATALOG_SQL} SELECT {ROWS} FROM catalog ORDER BY downloads DESC, slug LIMIT 20")
def trending(spark, sf):
    return C.trending(catalog(spark, sf)).select("slug", "name", "downloads")


@query("catalog_random", f"WITH {CATALOG_SQL} SELECT {ROWS} FROM catalog ORDER BY sha256('7:' || slug) LIMIT 1")
def random_pick(spark, sf):
    return C.random_pick(catalog(spark, sf), 7).select("slug", "name", "downloads")


FINDINGS_SQL = """f AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 20 = 0 THEN 'critical' ELSE 'info' END
    WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'high' ELSE 'info' END WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity FROM orders),
  v AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS value FROM f)"""


@query("findings_by_min_severity", f"WITH {FINDINGS_SQL} SELECT o_custkey, count(*) AS shown FROM v WHERE value >= 2 GROUP BY ALL")
def by_severity(spark, sf):
    return C.findings_at_least(order_findings(spark, sf), "medium").groupBy("o_custkey").agg(F.count("*").alias("shown"))


@query("findings_by_min_rating", f"WITH {FINDINGS_SQL} SELECT o_custkey, count(*) AS shown FROM v WHERE value >= 4 GROUP BY ALL")
def by_rating(spark, sf):
    return C.findings_at_rating(order_findings(spark, sf), "F").groupBy("o_custkey").agg(F.count("*").alias("shown"))


@query("severity_breakdown", f"""WITH {FINDINGS_SQL}, c AS (SELECT o_custkey, {', '.join(
    f"count(*) FILTER (WHERE value = {4 - i}) AS {s}" for i, s in enumerate(C.SEVERITIES))} FROM v GROUP BY ALL)
  SELECT *, coalesce(nullif(concat_ws(', ', {', '.join(f"CASE WHEN {s} > 0 THEN {s} || ' {s}' END" for s in C.SEVERITIES)}), ''), 'none') AS breakdown FROM c""")
def breakdown(spark, sf):
    return C.severity_breakdown(order_findings(spark, sf), "o_custkey")


@query("scanner_counts", """WITH r AS (SELECT l_partkey, 'scanner' || (l_suppkey % 5) AS source, CASE WHEN l_linenumber % 3 = 0 THEN 'errored' ELSE 'success' END AS status FROM lineitem)
  SELECT l_partkey, count(DISTINCT CASE WHEN source <> 'scanner0' THEN source END) + 1 AS scanners, string_agg(DISTINCT source, ', ' ORDER BY source) AS scanned_by
  FROM r WHERE status = 'success' GROUP BY l_partkey""")
def scanner_counts(spark, sf):
    runs = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "concat('scanner', l_suppkey % 5) source", "CASE WHEN l_linenumber % 3 = 0 THEN 'errored' ELSE 'success' END status")
    return C.scanner_counts(runs, "l_partkey", "scanner0")


@query("pairwise_compare", f"""WITH {CATALOG_SQL}, s AS (SELECT slug, unnest([struct_pack(k := 'grade', v := grade), struct_pack(k := 'license', v := license),
    struct_pack(k := 'author', v := author), struct_pack(k := 'description', v := description), struct_pack(k := 'downloads', v := CAST(downloads AS VARCHAR))]) AS a FROM catalog
    WHERE slug IN ('part-10', 'part-21'))
  SELECT coalesce(l.k, r.k) AS attribute, coalesce(l.v, '—') AS "left", coalesce(r.v, '—') AS "right" FROM
    (SELECT a.k AS k, a.v AS v FROM s WHERE slug = 'part-10' AND a.v IS NOT NULL) l FULL OUTER JOIN
    (SELECT a.k AS k, a.v AS v FROM s WHERE slug = 'part-21' AND a.v IS NOT NULL) r ON l.k = r.k""")
def compare(spark, sf):
    return C.compare(catalog(spark, sf), "part-10", "part-21", ["grade", "license", "author", "description", "downloads"])


@query("freshness_class", """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'verified_unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'unreachable'
    WHEN 3 THEN 'check_failed' WHEN 4 THEN 'other' END AS status FROM orders)
  SELECT status, CASE status WHEN 'verified_unchanged' THEN 'current' WHEN 'changed' THEN 'changed' WHEN 'unreachable' THEN 'unreachable' ELSE 'unknown' END AS class,
    count(*) AS skills FROM s GROUP BY ALL""")
def freshness(spark, sf):
    status = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN 'verified_unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'unreachable'
      WHEN 3 THEN 'check_failed' WHEN 4 THEN 'other' END""")
    return (table(spark, sf, "orders").select(status.alias("status")).groupBy("status").agg(F.count("*").alias("skills"))
            .withColumn("class", C.freshness(F.col("status"))))


@query("catalog_known_fields", """SELECT p_partkey, '{"slug":"part-' || p_partkey || '","name":"' || p_name || '"' || CASE WHEN p_size % 2 = 0
    THEN ',"language":"go"' ELSE '' END || ',"rankings":{"stars":' || p_size || '}}' AS card FROM part""")
def known_fields(spark, sf):
    raw = table(spark, sf, "part").selectExpr("p_partkey", """concat('{"internal":1,"rankings":{"stars":', p_size, ',"secret":2},"name":"', p_name, '"',
      CASE WHEN p_size % 2 = 0 THEN ',"language":"go"' ELSE '' END, ',"slug":"part-', p_partkey, '"}') card""")
    return C.known_fields(raw, "card")


@query("detail_roll_up", """SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN '—' ELSE array_to_string([CASE WHEN p_size % 2 = 1 THEN 'skill.md' END,
    CASE WHEN p_size // 2 % 2 = 1 THEN 'scripts' END, CASE WHEN p_size // 4 % 2 = 1 THEN 'evals' END], ', ') END AS contains,
  CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE '2024-05-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS last_scanned FROM part""")
def detail(spark, sf):
    size = F.col("p_size")
    flag = lambda n: F.floor(size / n) % 2 == 1
    stamp = F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('2024-05-', lpad(p_size % 28 + 1, 2, '0'), 'T10:00:00Z') END")
    return table(spark, sf, "part").select("p_partkey", C.contents_text(flag(1), flag(2), flag(4)).alias("contains"),
                                           C.date_part(stamp).alias("last_scanned"))


