"""Connected components of an edge table with DataFrame joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm.common import Workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``(id, component_id)`` for each id of ``edges(a, b)``; a component's id is its smallest member.

    Only tables of links are joined and grouped by their ends; nothing is gathered on the driver but
    a count and a checksum a round.  Loops and repeated edges are allowed; null ends are left out.
    The number of rounds grows with the logarithm of the longest chain.
    """
    now = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, step = _state(now), 0
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = work.keep(large, f"{name}-large-{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        small = work.keep(small, f"{name}-{step + 1}")
        after = _state(small)
        work.drop(f"{name}-{step}", f"{name}-large-{step}")
        now, step = small, step + 1
        if after == state:
            break
        state = after
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
