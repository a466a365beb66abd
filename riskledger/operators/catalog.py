"""Queries over a catalog of skills: search, facets, paging, findings, comparison.

``catalog`` rows: ``slug, name, description, author, category, grade, license, downloads, language,
agents, stars, leaderboard_rank, aggregators, official, updated_at`` (all but ``slug`` may be NULL).
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DASH = "—"
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_VALUE = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RATING_VALUE = {"F": 4, "C": 2, "B": 1}
SORT_COLUMNS = {"alpha": "name", "rating": "grade", "downloads": "downloads", "stars": "stars",
                "updated": "updated_at"}


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Rows whose slug, name or description holds the query, any case."""
    needle = query.lower()
    test = F.lit(False)
    for column in ("slug", "name", "description"):
        test = test | F.coalesce(F.lower(column).contains(needle), F.lit(False))
    return catalog.where(test)


def facets(catalog: DataFrame, languages=(), agents=(), rankings: dict | None = None) -> DataFrame:
    """Facet filters; ranking values are minimum thresholds, for the leaderboard rank a maximum."""
    out = catalog
    if languages:
        out = out.where(F.col("language").isin(*languages))
    if agents:
        out = out.where(F.arrays_overlap("agents", F.array(*[F.lit(a) for a in agents])))
    limits = rankings or {}
    for key, column in (("stars", "stars"), ("numberOfAggregators", "aggregators")):
        if limits.get(key) is not None:
            out = out.where(F.col(column) >= limits[key])
    if limits.get("skillsShLeaderboardRank") is not None:
        out = out.where(F.col("leaderboard_rank") <= limits["skillsShLeaderboardRank"])
    if limits.get("officialClaudeMarketplace") is not None:
        out = out.where(F.col("official") == limits["officialClaudeMarketplace"])
    return out


def sort_order(sort: str, reverse: bool = False) -> list[Column]:
    """Ascending for ``alpha``, descending otherwise; ``reverse`` flips; ties by slug."""
    ascending = (sort == "alpha") != reverse
    column = F.col(SORT_COLUMNS[sort])
    return [column.asc_nulls_last() if ascending else column.desc_nulls_last(), F.asc("slug")]


def page(catalog: DataFrame, sort: str = "alpha", reverse: bool = False, number: int = 1, size: int = 20) -> DataFrame:
    """One page of a sorted listing (a bounded top-k), with ``total`` and ``total_pages``."""
    rows = catalog.orderBy(*sort_order(sort, reverse)).offset((number - 1) * size).limit(size)
    total = catalog.agg(F.count("*")).scalar()
    return rows.withColumn("total", total).withColumns({
        "total_pages": F.ceil(F.col("total") / F.lit(size)), "page": F.lit(number)})


def write_sorted(catalog: DataFrame, folder: str, sort: str = "alpha", reverse: bool = False, ranges: int = 64) -> None:
    """Store a listing in sorted order, cut into up to ``ranges`` folders of about equal size.

    Pages are then read by position (:func:`page_of`); the order is that of :func:`sort_order`.
    """
    rows = catalog.repartitionByRange(ranges, *sort_order(sort, reverse)).withColumn("range", F.spark_partition_id())
    rows.write.mode("overwrite").partitionBy("range").parquet(folder)


def page_of(stored: DataFrame, sort: str = "alpha", reverse: bool = False, number: int = 1, size: int = 20) -> DataFrame:
    """One page of a listing that :func:`write_sorted` stored, as :func:`page` gives it.

    Counts of the ranges, few whatever the listing holds, tell in which of them the page lies; only those are
    read, so a late page costs as much as the first.
    """
    first, last = (number - 1) * size, number * size
    wanted, skip, total = [], 0, 0
    for r in stored.groupBy("range").count().orderBy("range").collect():
        if total + r["count"] > first and total < last:
            skip = skip if wanted else first - total
            wanted.append(r["range"])
        total += r["count"]
    rows = stored.where(F.col("range").isin(wanted)).drop("range").orderBy(*sort_order(sort, reverse)).offset(skip).limit(size)
    return rows.withColumns({"total": F.lit(total).cast("bigint"), "total_pages": F.ceil(F.lit(total) / F.lit(size)), "page": F.lit(number)})


WORD = "[a-z0-9]+"
K1, B = 1.2, 0.75


def search_index(catalog: DataFrame, columns=("slug", "name", "description")) -> DataFrame:
    """``term, slug, times, length``: the words of each row, to be stored and searched by :func:`ranked`.

    A row without a word has one entry with a null term, so that it counts among the rows.
    """
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(WORD), F.lit(0))
    listed = catalog.select("slug", words.alias("w")).select("slug", F.size("w").alias("length"), F.explode_outer("w").alias("term"))
    return listed.groupBy("term", "slug", "length").agg(F.count("*").alias("times"))


def update_index(index: DataFrame, changed: DataFrame, columns=("slug", "name", "description")) -> DataFrame:
    """The index with the entries of the ``changed`` rows replaced; others are not computed again."""
    return index.join(changed.select("slug").distinct(), "slug", "left_anti").unionByName(search_index(changed, columns))


def ranked(index: DataFrame, query: str, size: int = 20) -> DataFrame:
    """``slug, score``: the best rows for the words of a query by BM25, ties by slug."""
    terms = sorted(set(re.findall(WORD, query.lower())))
    rows = index.select("slug", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    found = index.where(F.col("term").isin(terms))
    known = found.groupBy("term").agg(F.count("*").alias("held"))
    weight = F.log(1 + (F.lit(rows.n) - F.col("held") + 0.5) / (F.col("held") + 0.5))
    part = F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / F.lit(rows["mean"] or 1.0)))
    scored = found.join(known, "term").groupBy("slug").agg(F.sum(weight * part).alias("score"))
    return scored.orderBy(F.desc("score"), "slug").limit(size)


def trending(catalog: DataFrame, size: int = 20) -> DataFrame:
    return catalog.orderBy(*sort_order("downloads")).limit(size)


def random_pick(catalog: DataFrame, seed: int) -> DataFrame:
    """One row that depends on the seed only, not on partitioning."""
    return catalog.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "slug"), 256)).limit(1)


def severity_value(severity: Column) -> Column:
    low = F.lower(severity)
    out = F.when(low == "critical", 4)
    for name, value in list(SEVERITY_VALUE.items())[1:]:
        out = out.when(low == name, value)
    return out.otherwise(0)


def findings_at_least(findings: DataFrame, level: str) -> DataFrame:
    return findings.where(severity_value(F.col("severity")) >= SEVERITY_VALUE.get(level.lower(), 0))


def findings_at_rating(findings: DataFrame, rating: str) -> DataFrame:
    return findings.where(severity_value(F.col("severity")) >= RATING_VALUE.get(rating.upper(), 0))


def severity_breakdown(findings: DataFrame, key: str) -> DataFrame:
    """Five counts per key and their text form (``none`` without findings)."""
    value = severity_value(F.col("severity"))
    counts = findings.groupBy(key).agg(*[
        F.count_if(value == v).alias(s) for s, v in zip(SEVERITIES, (4, 3, 2, 1, 0))])
    return counts.withColumn("breakdown", breakdown_text(*[F.col(s) for s in SEVERITIES]))


def breakdown_text(*counts: Column) -> Column:
    parts = [F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {s}"))) for c, s in zip(counts, SEVERITIES)]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("none"))


def scanner_counts(runs: DataFrame, key: str, own: str) -> DataFrame:
    """Distinct successful external scanners plus one, and the sorted names of all successful ones.

    Runs are reduced to distinct names first; the number of scanners is small by nature.
    """
    ok = runs.where("status = 'success'").select(key, "source").distinct()
    return ok.groupBy(key).agg(
        (F.count_if(F.col("source") != own) + 1).alias("scanners"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("scanned_by"))


def contents_text(has_skill_md: Column, has_scripts: Column, has_evals: Column) -> Column:
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in (
        (has_skill_md, "skill.md"), (has_scripts, "scripts"), (has_evals, "evals"))]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit(DASH))


def date_part(timestamp: Column) -> Column:
    return F.when(F.length(timestamp) >= 10, F.left(timestamp, F.lit(10))).otherwise(DASH)


def freshness(status: Column) -> Column:
    return (F.when(status == "verified_unchanged", "current").when(status.isin("changed", "unreachable"), status)
            .otherwise("unknown"))


def compare(catalog: DataFrame, left: str, right: str, attributes: list[str]) -> DataFrame:
    """Two slugs side by side: ``attribute, left, right``; an attribute only one side has shows a
    dash on the other, one that neither has is left out."""
    def side(slug, name):
        typed = catalog.where(F.col("slug") == slug).select(*[F.col(a).cast("string").alias(a) for a in attributes])
        return typed.unpivot([], attributes, "attribute", name).where(F.col(name).isNotNull())

    both = side(left, "left").join(side(right, "right"), "attribute", "full_outer")
    return both.select("attribute", F.coalesce("left", F.lit(DASH)).alias("left"),
                       F.coalesce("right", F.lit(DASH)).alias("right"))


CARD_SCHEMA = (
    "slug string, name string, description string, version string, author string, category string, "
    "badgeStatus string, overallGrade string, sourceType string, scannerRunCount int, language string, "
    "agentCompatibility array<string>, rankings struct<stars:int,skillsShLeaderboardRank:int,"
    "numberOfAggregators:int,officialClaudeMarketplace:boolean>, freshness struct<status:string,reason:string,"
    "retryable:boolean,renamedTo:string,lastCheckedAt:string,lastVerifiedAt:string,lastChangeDetectedAt:string,"
    "scannedHash:string,latestUpstreamHash:string>")


def known_fields(rows: DataFrame, column: str) -> DataFrame:
    """Rewrite a JSON column to the fields we know; others and absent ones are left out."""
    return rows.withColumn(column, F.to_json(F.from_json(column, CARD_SCHEMA)))
