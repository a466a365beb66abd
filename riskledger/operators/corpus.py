"""Corpus operators: which files of an inventory are candidates, and under which origin.

Input rows: ``scan_id, root, path, origin, content, size_bytes, modified_at`` plus optional
``declared_tools, permissions, dependencies``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskledger.catalog import names
from riskledger.functions import paths
from riskledger.functions.sqltext import str_array

OPTIONAL_LISTS = ("declared_tools", "permissions", "dependencies")


def with_path_parts(files: DataFrame) -> DataFrame:
    """Add ``name``, ``dir`` and the optional list columns that are missing."""
    out = files
    for column in OPTIONAL_LISTS:
        if column not in out.columns:
            out = out.withColumn(column, F.array().cast("array<string>"))
    return out.withColumn("name", paths.basename(F.col("path"))).withColumn(
        "dir", paths.parent_dir(F.col("path")))


def _relative_dirs(path: Column, root: Column) -> Column:
    parts = F.split(paths.relative_to(path, root), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def below_excluded_dir(path: Column, root: Column, system: bool = False) -> Column:
    """Is any directory between root and file on the exclusion list (the root never is)?"""
    listed = names.EXCLUDED_DIRS + (names.SYSTEM_EXCLUDED_DIRS if system else [])
    return F.arrays_overlap(_relative_dirs(path, root), str_array(listed))


def relative_depth(path: Column, root: Column) -> Column:
    return F.size(F.split(paths.relative_to(path, root), "/"))


def editor_noise(path: Column, root: Column) -> Column:
    """Files met inside a ``.vscode`` directory on the way, other than its own ``mcp.json``."""
    dirs = _relative_dirs(path, root)
    first = F.array_position(dirs, ".vscode")
    direct = (first == F.size(dirs)) & (paths.basename(path) == "mcp.json")
    return (paths.basename(root) != ".vscode") & (first > 0) & ~direct


def candidates(files: DataFrame, system: bool = False) -> DataFrame:
    path, root = F.col("path"), F.col("root")
    return files.where(~below_excluded_dir(path, root, system) & ~editor_noise(path, root))


#: Tier directories below a home of each system: ``(directory, tier, rank)``.
_TIER_DIRS = {
    os_name: [(d, "host", 1) for d in [*names.HOST_CONFIG_DIRS, *[f"{base}/{d}" for d in names.EDITOR_USER_DIRS]]]
    + [(d, "home", 2) for d in names.USER_SPACE_DIRS[os_name]] for os_name, base in names.EDITOR_BASE.items()}


def tier_roots(homes: DataFrame) -> DataFrame:
    """Tier roots of each ``(scan_id, os, home)``: ``root, tier, tier_rank``."""
    arms = None
    for os_name, rows in _TIER_DIRS.items():
        listed = F.array(*[F.struct(F.lit(d).alias("rel"), F.lit(tier).alias("tier"), F.lit(rank).alias("rank")) for d, tier, rank in rows])
        arms = F.when(F.col("os") == os_name, listed) if arms is None else arms.when(F.col("os") == os_name, listed)
    return (homes.select("scan_id", "home", F.explode(F.coalesce(arms, F.array())).alias("r"))
            .select("scan_id", F.concat("home", F.lit("/"), F.col("r.rel")).alias("root"),
                    F.col("r.tier").alias("tier"), F.col("r.rank").alias("tier_rank")))


def tiers_of(files: DataFrame, homes: DataFrame) -> DataFrame:
    """``scan_id, path, tier, tier_rank``: every tier that a file lies in (``homes``: ``scan_id, os, home``).

    A file meets the homes among its ancestor directories, an equality with one row a home.  Which tier roots lie
    between home and file is read off its path, so the roots of all homes are never written out.  The planner knows
    homes by their compressed size only, so they are kept from being broadcast.
    """
    above = files.select("scan_id", "path", F.explode(paths.ancestor_dirs(paths.parent_dir(F.col("path")))).alias("home"))
    met = above.join(homes.select("scan_id", "os", "home").hint("merge"), ["scan_id", "home"]).withColumn("dir", paths.parent_dir(F.col("path")))
    inner = paths.ancestor_dirs(paths.relative_to(F.col("dir"), F.col("home")))

    def below(rank):
        met_by = [F.when(F.col("os") == os_name, F.arrays_overlap(inner, str_array([rel for rel, _, r in rows if r == rank])))
                  for os_name, rows in _TIER_DIRS.items()]
        return (F.col("dir") != F.col("home")) & F.coalesce(*met_by, F.lit(False))

    tier = lambda name, rank: F.struct(F.lit(name).alias("tier"), F.lit(rank).alias("tier_rank"))
    found = F.array(F.when(F.col("dir") == F.col("home"), tier("home", 0)), F.when(below(1), tier("host", 1)),
                    F.when(below(2), tier("home", 2)))
    return met.select("scan_id", "path", F.inline(F.array_compact(found)))


def assign_origin(files: DataFrame, homes: DataFrame) -> DataFrame:
    """Origin of each file under a home: direct home files first, then host roots, then user space.

    A file below several roots gets the first tier.
    """
    return (tiers_of(files, homes).groupBy("scan_id", "path").agg(F.min(F.struct("tier_rank", "tier")).alias("m"))
            .select("scan_id", "path", F.col("m.tier").alias("origin")))


def dedupe_first_origin(files: DataFrame, order: str = "tier_rank") -> DataFrame:
    """First row per path in tier order (the same path may come from several roots)."""
    w = Window.partitionBy("scan_id", "path").orderBy(order)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spread_rank(rows: DataFrame, keys, digest: Column, name: str = "rank") -> DataFrame:
    """Exact 1-based rank per key in digest order, plus ``<name>_total``, without sorting a key in
    one task.

    Digests spread evenly, so their first digits cut every key into small shares.  A table of
    counts per share (at most 4096 rows a key) gives each share its offset, and ranking happens
    inside shares only.
    """
    keys = list(keys)
    marked = rows.withColumn("_digest", digest).withColumn("_share", F.substring("_digest", 1, 3))
    running = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    counts = (marked.groupBy(*keys, "_share").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
              .withColumn(f"{name}_total", F.sum("_n").over(Window.partitionBy(*keys))).drop("_n"))
    inside = Window.partitionBy(*keys, "_share").orderBy("_digest")
    return (marked.join(counts, [*keys, "_share"])
            .withColumn(name, F.col("_before") + F.row_number().over(inside))
            .drop("_digest", "_share", "_before"))


def in_walk_order(files: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Every file with ``walk_rank`` and ``walk_total`` in its scan, in the order of path digests.

    The order of a directory walk is undefined, so any fixed order will do.
    """
    digest = F.sha2(F.concat_ws("/", *keys, "path"), 256)
    ranked = spread_rank(files, keys, digest, "walk_rank")
    return ranked.withColumnRenamed("walk_rank_total", "walk_total")


def salted_join(big: DataFrame, small: DataFrame, keys, spread, how: str = "inner", salts: int = 16, parts: int | None = None) -> DataFrame:
    """Equi-join in which one key of ``big`` may hold most rows.

    Rows of ``big`` go to one of ``salts`` shares of their key (by the ``spread`` columns), and the
    rows of ``small``, few per key, are repeated for every share.  The result is that of the plain
    join (``how``: inner, left or left_semi).

    Repeated rows and path prefixes are packed to a small part of their size in a shuffle, by which the planner would
    broadcast them whole or bring many partitions to one task.  So both sides are dealt to a fixed number of partitions
    (``parts``, by default the session's).
    """
    parts = parts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*keys, "_salt"]
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on, how).drop("_salt")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def top_n(df: DataFrame, keys, order, n: int, salt_from, salts: int = 32) -> DataFrame:
    """First ``n`` rows per key.  Ranks inside hashed shares first, so a key with most of the rows
    is reduced in many tasks before the last ranking sees at most ``salts * n`` of its rows."""
    keys = list(keys)
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)))
            .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_salt", "_n")
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n))


def beyond_top_n(df: DataFrame, keys, order, n: int, salt_from, salts: int = 32) -> DataFrame:
    """The rows that :func:`top_n` leaves out, from one pass: what is not among the first ``n`` of its
    share is out, and the few others are ranked per key."""
    keys = list(keys)
    shares = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = F.when(F.col("_n") > n, F.col("_salt")).otherwise(-1)
    last = Window.partitionBy(*keys, "_group").orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts))).withColumn("_n", F.row_number().over(shares))
            .withColumn("_group", few).withColumn("_last", F.row_number().over(last))
            .where((F.col("_n") > n) | (F.col("_last") > n)).drop("_salt", "_n", "_group", "_last"))
