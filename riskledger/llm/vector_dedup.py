"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more are at squared distance 2 - 2c or less.  A fixed random rotation
spreads that distance evenly; cut into blocks, at least one block of a near pair is within the block's
share of the budget.  Each block is range-joined on a grid over its first coordinates: a vector lives
in one cell and visits every cell within the block's radius.  What a block finds is verified on the
whole original vectors and belongs to the first block that could have found it, so the union has no
repeats and links are counted where they are found, never listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm.common import Workspace, by_group, group_starts, query, table
from riskledger.llm.components import components
from riskledger.llm.vectors import classed, matrix, vectors


@dataclass(frozen=True)
class Pigeonhole:
    """Production parameters: ``block`` dimensions a block; a grid has about ``cell`` rows a cell, a
    cell of more than ``chunk`` rows is joined in parts."""

    cosine: float = 0.9
    block: int = 16
    cell: int = 65_536
    chunk: int = 65_536
    seed: int = 3


SLACK = 1e-4
#: Jobs that share the blocks of a vector: copies of vectors for a job's cells are on disk for that job only.
ROUNDS = 8
CELLS_DDL = "vec_id long, embedding {kind}, n long, dim int, block int, cell long, home boolean"
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class Blocks:
    """Rotation and blocks of vectors with ``dim`` components."""

    def __init__(self, dim: int, rows: int, p: Pigeonhole):
        rng = np.random.default_rng(p.seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        count = -(-dim // p.block)
        self.edges = np.linspace(0, dim, count + 1).astype(int)
        self.budget = (2 - 2 * p.cosine) * np.diff(self.edges) / dim
        self.grid = max(1, min(int(np.diff(self.edges).min()), math.ceil(math.log2(max(2, rows / p.cell)))))

    def cells(self, rotated: np.ndarray, b: int):
        """(row, cell, home) for every cell of block b that a row lives in or visits.

        Cells are two radii wide, so in each coordinate a row is near one border at most.
        """
        radius = math.sqrt(self.budget[b] + SLACK)
        own = rotated[:, self.edges[b]:self.edges[b] + self.grid] / (2 * radius)
        low = np.floor(own)
        share = own - low
        step = np.where(share < 0.5, -1, 1)
        gap = np.where(share < 0.5, share, 1 - share) * 2 * radius
        for mask in range(1 << self.grid):
            bits = (mask >> np.arange(self.grid)) & 1
            near = ((gap * bits) ** 2).sum(axis=1) <= radius * radius
            cell = (low + step * bits).astype(np.int64)
            number = np.zeros(len(own), np.int64)
            for k in range(self.grid):
                number = number * 1_000_003 + cell[:, k]
            rows = np.flatnonzero(near)
            yield rows, number[rows], mask == 0


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spread(sizes: dict[int, int], p: Pigeonhole, turn: int = 0, rounds: int = 1):
    """Rows into cells, for vectors of each length in ``sizes``: the blocks of one of ``rounds`` turns."""
    def run(batches):
        made = {}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("embedding")])
            for dim in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                blocks = made.setdefault(dim, Blocks(dim, sizes[dim], p))
                rotated = unit(matrix(own.column("embedding"))) @ blocks.rotation
                for b in range(turn, len(blocks.budget), rounds):
                    for rows, cells, home in blocks.cells(rotated, b):
                        if len(rows):
                            part = own.take(pa.array(rows))
                            n = len(rows)
                            yield pa.RecordBatch.from_arrays(
                                [*part.select(["vec_id", "embedding", "n"]).columns, pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)),
                                 pa.array(cells), pa.array(np.full(n, home))], names=["vec_id", "embedding", "n", "dim", "block", "cell", "home"])
    return run


def linked(sizes: dict[int, int], p: Pigeonhole):
    """Counts (a, null, n) and star edges (a, b, 0) of the cells in a table sorted by cell and tile."""
    keys = ["dim", "block", "cell", "tile"]

    def pairs(x, ids, blocks, b, homes, members):
        """Verified pairs (home, member) that block b is the first to find."""
        rotated = x @ blocks.rotation
        s, e = blocks.edges[b], blocks.edges[b + 1]
        right = rotated[members, s:e].astype(np.float32)
        right = np.column_stack([right, -(right.astype(np.float64) ** 2).sum(axis=1) / 2]).astype(np.float32)
        strips = [(members[m:m + 2048], np.ascontiguousarray(right[m:m + 2048].T)) for m in range(0, len(members), 2048)]
        for at in range(0, len(homes), 256):
            some = homes[at:at + 256]
            left = rotated[some, s:e].astype(np.float32)
            need = ((left.astype(np.float64) ** 2).sum(axis=1) - blocks.budget[b] - SLACK) / 2
            left, need = np.column_stack([left, np.ones(len(some), np.float32)]), need[:, None].astype(np.float32)
            i, j = [], []
            for strip, columns in strips:
                met = np.flatnonzero(left @ columns >= need)
                if len(met):
                    i.append(some[met // len(strip)])
                    j.append(strip[met % len(strip)])
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (i, j))
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            for k in range(0, len(i), 1 << 17):
                u, v = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
                near = np.einsum("ij,ij->i", x[u], x[v]) >= p.cosine
                u, v = u[near], v[near]
                gap = x[u] - x[v]
                mine = np.ones(len(u), bool)
                for c in range(b + 1):
                    side = np.einsum("ij,jk->ik", gap[mine], blocks.rotation[:, blocks.edges[c]:blocks.edges[c + 1]])
                    within = np.einsum("ij,ij->i", side, side) <= blocks.budget[c] + 1e-9
                    mine[np.flatnonzero(mine)[within if c < b else ~within]] = False
                if mine.any():
                    yield u[mine], v[mine]

    def work(rows: pa.Table):
        starts = group_starts(rows, keys)
        ids, n = rows.column("vec_id").to_numpy(), rows.column("n").to_numpy()
        home, member = (rows.column(c).to_numpy() > 0 for c in ("as_home", "as_member"))
        out: list[list] = [[], [], []]
        for s, e in zip(starts, [*starts[1:], rows.num_rows]):
            homes, members = np.flatnonzero(home[s:e]), np.flatnonzero(member[s:e])
            if not len(homes) or e - s < 2:
                continue
            dim, b = rows.column("dim")[int(s)].as_py(), rows.column("block")[int(s)].as_py()
            blocks = made.setdefault(dim, Blocks(dim, sizes[dim], p))
            x, own = unit(matrix(rows.column("embedding").slice(s, e - s))), ids[s:e]
            count, label = np.zeros(e - s, np.int64), np.arange(e - s)
            for u, v in pairs(x, own, blocks, b, homes, members):
                count += np.bincount(u, weights=n[s:e][v], minlength=e - s).astype(np.int64)
                _join(label, u, v)
            some, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(e - s))
            for column, values in zip(out, ((own[some], own[tied]), (own[some], own[label[tied]]), (count[some], np.zeros(len(tied), np.int64)))):
                column += values
        if out[0]:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=FOUND)
    made: dict[int, Blocks] = {}
    return by_group(keys, work)


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the parts of u and v; ``label`` points from each row to the first row of its part."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _tiled(cells: DataFrame, p: Pigeonhole) -> DataFrame:
    """Rows of cells, those of large cells once for each tile, sorted by cell and tile."""
    key = ["dim", "block", "cell"]
    large = cells.groupBy(*key).agg(F.ceil(F.count("*") / p.chunk).alias("parts")).where("parts > 1")
    cells = cells.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    roles = F.expr("""explode(if(parts = 1, array(struct(0L as tile, int(home) as as_home, 1 as as_member)), concat(
        transform(sequence(0L, parts - 1), t -> struct(own * parts + t as tile, int(home) as as_home, 0 as as_member)),
        transform(sequence(0L, parts - 1), t -> struct(t * parts + own as tile, 0 as as_home, 1 as as_member)))))""")
    cells = cells.select(*key, "vec_id", "embedding", "n", roles.alias("r")).select(*key, "r.*", "vec_id", "embedding", "n").where("as_home + as_member > 0")
    return cells.repartition(*key, "tile").sortWithinPartitions(*key, "tile")


def near_vectors(table_: DataFrame, p: Pigeonhole | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each distinct vec_id.

    Vectors with cosine ``cosine`` or more, in double precision, are linked; n_links counts the others
    linked directly, component_id is the smallest vec_id reachable.  Vectors that are null, zero or hold
    null or non-finite components link with nothing, and vectors of different length never link.  Rows
    that repeat a vec_id count as one vector, the smallest; a null vec_id links with nothing and has a
    null component.  Equal vectors are joined once and count with their number.  Vectors of floats stay floats on
    disk and in shuffles; all arithmetic is in double precision.
    """
    p, work = p or Pigeonhole(), Workspace(table_.sparkSession, free_shuffles=True)
    given = table_.schema["embedding"].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"
    every = work.keep(vectors(table_).withColumn("embedding", F.col("embedding").cast(kind)), "vectors")
    keyed = classed(every)
    classes = work.keep(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = work.keep(every.join(classes.select(F.col("rep").alias("vec_id"), "n"), "vec_id"), "reps")
    sizes = {r["dim"]: r["n"] for r in reps.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    rounds = min(ROUNDS, max((-(-dim // p.block) for dim in sizes), default=1))
    found = None
    for turn in range(rounds):
        cells = reps.select("vec_id", "embedding", "n").mapInArrow(spread(sizes, p, turn, rounds), CELLS_DDL.format(kind=kind))
        part = work.keep(_tiled(cells, p).mapInArrow(linked(sizes, p), "a long, b long, n long"), f"found{turn}")
        found = part if found is None else found.unionByName(part)
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("far"))
    tied = components(found.where("n = 0").select("a", "b"), work)
    classes = classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(tied.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("k1", "k2", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    classes = work.keep(classes, "linked")
    known = keyed.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = every.join(known.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
  parts AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(p.c, e.vec_id) AS component_id, coalesce(p.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN parts p ON p.x = e.vec_id"""


@query("op6_vector_near_dedup", _SQL)
def op6(spark, sf_dir):
    """Near-duplicate embeddings: cosine 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
