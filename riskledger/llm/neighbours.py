"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

The trees are grown on a bounded sample: a node splits its sample at the median along the difference of
two random members.  Every vector goes to a leaf of each tree.  A query walks all trees through one
priority queue, nearest margins first, until it has seen its share of entries; each leaf then scores its
own members for its queries exactly, in double precision, and keeps the best.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.llm.common import Workspace, by_group, group_starts, query, table
from riskledger.llm.vectors import classed, matrix, vectors


@dataclass(frozen=True)
class Forest:
    """Production parameters.

    The forest is grown on the ``sample`` vectors of the smallest hashes.  A tree has about ``leaves``
    leaves, fewer where they would hold less than ``least`` rows.  A query looks at the part ``share`` of all
    leaf entries (trees times rows), and at ``entries`` at least.  One group holds about ``chunk`` members
    of a leaf and ``chunk`` of its queries.
    """

    trees: int = 6
    leaves: int = 32
    least: int = 256
    share: float = 0.2
    entries: int = 6144
    sample: int = 50_000
    neighbours: int = 20
    query_step: int = 20
    chunk: int = 65_536
    seed: int = 5


class Trees:
    """Grown trees; a leaf has one number over all trees, and the part of all rows it should hold."""

    def __init__(self, sample: np.ndarray, rows: int, p: Forest):
        rng = np.random.default_rng(p.seed)
        self.norm = float(np.sqrt((sample ** 2).sum(axis=1).max())) if len(sample) else 1.0
        points = self.lifted(sample)
        self.normals, self.cuts, self.children, self.roots, self.part = [], [], [], [], []
        least = max(8, -(-len(sample) // p.leaves), p.least * len(sample) // max(rows, 1))
        self.goal = p.trees * max(p.share, p.entries / max(1, rows * p.trees))

        def grow(index):
            while len(index) > least:
                a, b = rng.choice(index, 2, replace=False)
                normal = points[a] - points[b]
                length = np.linalg.norm(normal)
                if length < 1e-12:
                    same = np.linalg.norm(points[index] - points[a], axis=1) < 1e-12
                    if same.all():
                        break
                    normal = points[a] - points[index[~same][0]]
                    length = np.linalg.norm(normal)
                shadow = points[index] @ (normal / length)
                cut = float(np.median(shadow))
                low = shadow < cut
                if not low.any() or low.all():
                    cut = float((shadow.min() + shadow.max()) / 2)
                    low = shadow < cut
                if not low.any() or low.all():
                    break
                node = len(self.normals)
                self.normals.append(normal / length)
                self.cuts.append(cut)
                self.children.append(None)
                self.children[node] = (grow(index[low]), grow(index[~low]))
                return node
            self.part.append(len(index) / max(1, len(sample)))
            return -len(self.part)
        for _ in range(p.trees):
            self.roots.append(grow(np.arange(len(sample))))
        self.normals = np.array(self.normals).reshape(len(self.normals), points.shape[1])
        self.cuts = np.array(self.cuts)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate makes all rows equally long, so that near means a large inner product."""
        rest = np.maximum(self.norm ** 2 - (x ** 2).sum(axis=1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees leaf numbers."""
        side = self.lifted(x) @ self.normals.T >= self.cuts if len(self.cuts) else None
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    out[rows, t] = -node - 1
                elif len(rows):
                    high = side[rows, node]
                    todo.append((self.children[node][0], rows[~high]))
                    todo.append((self.children[node][1], rows[high]))
        return out

    def search(self, q: np.ndarray) -> list[int]:
        """Leaves in the order of one queue over all trees, until enough entries are seen."""
        margin = (np.append(q, 0.0) @ self.normals.T - self.cuts).tolist() if len(self.cuts) else []
        queue = [(float("-inf"), root) for root in self.roots]
        heapq.heapify(queue)
        out, seen = [], 0.0
        while queue and seen < self.goal:
            worst, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                seen += self.part[-node - 1]
                continue
            low, high = self.children[node]
            heapq.heappush(queue, (max(worst, margin[node]), low))
            heapq.heappush(queue, (max(worst, -margin[node]), high))
        return out


GROUP = ["leaf", "part", "ask_part"]


def _leaf_scores(p: Forest, keep: int):
    """The best ``keep`` members of each (leaf, part, ask_part) for each of its queries."""
    def work(rows: pa.Table):
        starts = group_starts(rows, GROUP)
        asks, ids, x = rows.column("ask").to_numpy(), rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"))
        out: list[list] = [[], [], []]
        for s, e in zip(starts, [*starts[1:], rows.num_rows]):
            own = asks[s:e].astype(bool)
            queries, members = np.flatnonzero(own) + s, np.flatnonzero(~own) + s
            if not len(members):
                continue
            for at in range(0, len(queries), 512):
                some = queries[at:at + 512]
                score = x[some] @ x[members].T
                if len(members) > keep:
                    bound = np.partition(score, len(members) - keep, axis=1)[:, len(members) - keep]
                    q, m = np.nonzero(score >= (bound - 1e-9 * np.maximum(1, np.abs(bound)))[:, None])
                else:
                    q, m = (a.ravel() for a in np.indices(score.shape))
                out[0].append(ids[some][q])
                out[1].append(ids[members][m])
                out[2].append(np.einsum("ij,ij->i", x[some][q], x[members][m]))
        if out[0]:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query", "vec_id", "score"])
    return by_group(GROUP, work)


def nearest(table_: DataFrame, p: Forest | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the neighbours found of each vec_id divisible by ``query_step``.

    Largest inner product first, equal ones by smaller vec_id, a query is not its own neighbour.
    Vectors that are null, zero or hold null or non-finite components take no part; rows with a null
    vec_id neither, and rows that repeat a vec_id count once.  Vectors of another length than most are
    searched among those of the same length.  Equal vectors are indexed and searched once, then
    expanded to their smallest ids, which are all that a result can need.  No rows, no result.
    """
    p, work = p or Forest(), Workspace(table_.sparkSession)
    spark = table_.sparkSession
    rows = work.keep(classed(vectors(table_)).withColumn("dim", F.size("embedding")), "vectors")
    order = Window.partitionBy("k1", "k2").orderBy("vec_id")
    alike = rows.select("k1", "k2", "vec_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= p.neighbours + 1)
    alike = work.keep(alike, "alike")
    single = rows.join(alike.where("place = 1").select("vec_id"), "vec_id", "left_semi")
    asked = rows.where(F.col("vec_id") % p.query_step == 0).select("k1", "k2", "vec_id")
    asked_for = work.keep(asked.groupBy("k1", "k2").agg(F.lit(1).alias("ask")), "asked")
    single = work.keep(single.join(asked_for, ["k1", "k2"], "left").fillna(0, ["ask"]), "single")
    found = None
    for dim, n in sorted((r["dim"], r["n"]) for r in single.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        part = _of_one_length(work, single.where(F.col("dim") == dim), n, dim, p)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = work.keep(best.withColumn("place", first).where(F.col("place") <= p.neighbours + 1).drop("place"), "best")
    key = rows.select(F.col("vec_id").alias("query"), "k1", "k2")
    of_class = (best.join(key, "query").join(asked.select("k1", "k2", F.col("vec_id").alias("query_id")), ["k1", "k2"])
                .select("query_id", "vec_id", "score"))
    members = alike.where("place = 1").select("k1", "k2", "vec_id").join(alike.select("k1", "k2", F.col("vec_id").alias("member")), ["k1", "k2"])
    out = of_class.join(members, "vec_id").where("member <> query_id").select("query_id", F.col("member").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= p.neighbours).select("query_id", "rank", "vec_id", "score")


def _parts(leaves: DataFrame, p: Forest):
    """The number of parts of each leaf by its rows in ``leaves``, as a column over ``leaf``."""
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / p.chunk).alias("parts"))
    sizes = {r["leaf"]: r["parts"] for r in sizes.where("parts > 1").collect()}
    parts = F.lit(1).cast("long")
    if sizes:
        parts = F.coalesce(F.create_map(*(F.lit(v).cast("long") for kv in sizes.items() for v in kv))[F.col("leaf")], parts)
    return parts


def _of_one_length(work: Workspace, single: DataFrame, n: int, dim: int, p: Forest) -> DataFrame:
    """query, vec_id, score: candidates of the classes asked for."""
    both = _meetings(work, single, n, dim, p).repartition(*GROUP).sortWithinPartitions(*GROUP, "ask")
    return both.mapInArrow(_leaf_scores(p, p.neighbours + 1), "query long, vec_id long, score double")


def _meetings(work: Workspace, single: DataFrame, n: int, dim: int, p: Forest) -> DataFrame:
    """leaf, part, ask_part, ask, vec_id, embedding: each query of a leaf meets each of its members in one group."""
    spark = single.sparkSession
    sample = single.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("embedding").toArrow()
    trees = spark.sparkContext.broadcast(Trees(matrix(sample.column(0)), n, p))

    def enter(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = trees.value.leaves(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(
                    np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1], leaves.ravel())], names=[*batch.schema.names, "leaves"])

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                found = [trees.value.search(q) for q in matrix(batch.column("embedding"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])
    ddl = "vec_id long, embedding array<double>, leaves array<long>"
    own = single.select("vec_id", "embedding")
    entries = own.mapInArrow(enter, ddl).select("vec_id", "embedding", F.explode("leaves").alias("leaf"))
    parts = _parts(own.mapInArrow(enter, ddl).select(F.explode("leaves").alias("leaf")), p)
    asked = work.keep(single.where("ask = 1").select("vec_id", "embedding").mapInArrow(ask, ddl), f"asked-{dim}")
    ask_parts = _parts(asked.select(F.explode("leaves").alias("leaf")), p)
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    entries = entries.select("leaf", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), every(ask_parts).alias("ask_part"),
                             F.lit(0).alias("ask"), "vec_id", "embedding")
    queries = asked.select("vec_id", "embedding", F.explode("leaves").alias("leaf"))
    queries = queries.select("leaf", every(parts).alias("part"), F.pmod(F.xxhash64("vec_id"), ask_parts).alias("ask_part"),
                             F.lit(1).alias("ask"), "vec_id", "embedding")
    return entries.union(queries)


@query("op2_nearest_neighbours")
def op2(spark, sf_dir):
    """The 20 nearest found of every vec_id divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
