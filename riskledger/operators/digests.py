"""Digests of directories, so that two inventories are compared from directories down to files.

A state table has ``scan_id, path, state_key`` (:func:`riskledger.operators.incremental.with_state_key`), one
row a file.  A directory has two digests: ``own`` over the files that lie in it, and ``tree`` over the own
digests of all directories below it and its own.  Equal trees hold equal files, and nothing in them is
looked at.  Rows without scan or path take no part; a state key that is null counts as empty.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.functions import paths

DIR, FILE = ["scan_id", "dir"], ["scan_id", "path"]
#: Digits of an item's share on each level of a digest, the last one the whole.
LEVELS = (4, 2, 0)


def bag_digest(rows: DataFrame, keys: list[str], item: Column, name: str, count: Column, note: Column) -> DataFrame:
    """``keys, name, items, note``: digest of the bag of texts ``item`` under each key, whatever their order.

    Items are hashed and joined in sorted order within shares, shares in wider shares.  A list holds the
    65,536th part of a key's items, or 256 digests of shares.  ``items`` sums ``count``; ``note`` is the largest.
    """
    level = rows.select(*keys, F.sha2(item, 256).alias("digest"), count.alias("items"), note.alias("note"))
    level = level.withColumn("share", F.col("digest"))
    for digits in LEVELS:
        ordered = F.array_sort(F.collect_list(F.struct("share", "digest")))
        level = (level.groupBy(*keys, F.left("share", F.lit(digits)).alias("part"))
                 .agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["digest"]), "\n"), 256).alias("digest"),
                      F.sum("items").alias("items"), F.max("note").alias("note"))
                 .withColumnRenamed("part", "share"))
    return level.select(*keys, F.col("digest").alias(name), "items", "note")


def _directory(path: Column) -> Column:
    """The directory of a file; ``/`` is written as the empty text, which is the first ancestor of all."""
    found = paths.parent_dir(path)
    return F.when(found == "/", "").otherwise(found)


def directory_digests(states: DataFrame) -> DataFrame:
    """``scan_id, dir, own, files, tree, tree_files`` of every directory that has a file somewhere below.

    ``own`` is null where no file lies in the directory itself.  Files are read and meet once, to give the own
    digests; trees are made of distinct directories and their ancestors, without a loop over depths.
    """
    stated = states.where("scan_id is not null and path is not null")
    item, one = F.concat_ws("\n", "path", F.coalesce("state_key", F.lit(""))), F.lit(1).cast("bigint")
    own = bag_digest(stated.withColumn("dir", _directory(F.col("path"))), DIR, item, "own", one, F.lit(None).cast("string"))
    below = own.select("scan_id", F.explode(paths.ancestor_dirs(F.col("dir"))).alias("above"), "dir", "own", "items")
    itself = F.when(F.col("above") == F.col("dir"), F.struct("own", "items"))
    below = below.select("scan_id", F.col("above").alias("dir"), F.concat_ws("\n", "dir", "own").alias("line"), "items", itself.alias("itself"))
    tree = bag_digest(below, DIR, F.col("line"), "tree", F.col("items"), F.col("itself"))
    return tree.select(*DIR, F.col("note.own").alias("own"), F.coalesce("note.items", F.lit(0)).alias("files"), "tree",
                       F.col("items").alias("tree_files"))


def compare_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """``scan_id, dir, state, own_differs``: directories of either inventory; ``state`` is new, gone, changed or same."""
    before = old.select(*DIR, F.col("own").alias("old_own"), F.col("tree").alias("old_tree"))
    after = new.select(*DIR, F.col("own").alias("new_own"), F.col("tree").alias("new_tree"))
    state = (F.when(F.col("old_tree").isNull(), "new").when(F.col("new_tree").isNull(), "gone")
             .when(F.col("old_tree") != F.col("new_tree"), "changed").otherwise("same"))
    return before.join(after, DIR, "full").select(
        *DIR, state.alias("state"), (~F.col("old_own").eqNullSafe(F.col("new_own"))).alias("own_differs"))


def unchanged_roots(compared: DataFrame) -> DataFrame:
    """``scan_id, dir`` of the topmost unchanged directories: a lister need not go below them."""
    same = compared.where("state = 'same'").select(*DIR)
    up = F.when(F.col("dir") != "", _directory(F.col("dir")))
    above = same.select("scan_id", F.col("dir").alias("up"))
    return same.withColumn("up", up).join(above, ["scan_id", "up"], "left_anti").select(*DIR)


def changed_files(old_states: DataFrame, new_states: DataFrame, compared: DataFrame) -> DataFrame:
    """``scan_id, path, state``: new, gone and changed files.  Only files that lie in directories whose own
    digest differs are compared."""
    look = compared.where("own_differs").select(*DIR)
    inside = lambda df, key: (df.select(*FILE, F.col("state_key").alias(key), _directory(F.col("path")).alias("dir"))
                              .join(look, DIR, "left_semi").withColumn(f"in_{key}", F.lit(True)).drop("dir"))
    both = inside(old_states, "old_key").join(inside(new_states, "new_key"), FILE, "full")
    state = (F.when(F.col("in_old_key").isNull(), "new").when(F.col("in_new_key").isNull(), "gone")
             .when(~F.col("old_key").eqNullSafe(F.col("new_key")), "changed"))
    return both.select(*FILE, state.alias("state")).where("state is not null")
