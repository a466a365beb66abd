"""Helpers of the llm operators: tables, kept intermediate results, grouped streaming in tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local run that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Workspace:
    """Tables that cut lineage: Parquet under the shared folder, so lost executors lose nothing.

    ``drop`` removes tables that no later step reads.  What a returned frame still reads stays until
    the caller deletes the ``llm-*`` folder.  With ``free_shuffles`` the shuffle files of a table go as
    soon as it is written, so disk use is that of the widest step and not of all together.
    """

    FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, free_shuffles: bool = False):
        self.spark, self.root = spark, f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.free_shuffles = free_shuffles

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(self.FREE, "false")
        if self.free_shuffles:
            self.spark.conf.set(self.FREE, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if self.free_shuffles:
                self.spark.conf.set(self.FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, rows: int, byte_column: str | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has at most ``rows`` rows and about ``most`` bytes of a text column."""
    if byte_column is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    import pyarrow.compute as pc
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(byte_column)).fill_null(0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(size, base + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def by_group(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]):
    """A ``mapInArrow`` function over partitions sorted by ``keys``: ``work`` gets whole groups.

    One call gets all groups that end in a batch, so small groups share the cost of a call; a group
    is held until its last row has come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                last, first = held[-1].slice(held[-1].num_rows - 1, 1), batch.slice(0, 1)
                if any(last.column(k)[0] != first.column(k)[0] for k in keys):
                    out = work(pa.Table.from_batches(held))
                    held = []
                    if out is not None and out.num_rows:
                        yield out
            start = group_starts(batch, keys)[-1]
            if start > 0:
                out = work(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = [batch.slice(start)]
                if out is not None and out.num_rows:
                    yield out
            else:
                held.append(batch)
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out
    return run


def group_starts(rows, keys: list[str]) -> np.ndarray:
    """Where a new group begins, in rows sorted by non-null integer keys."""
    n = rows.num_rows
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        column = rows.column(k)
        values = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def tiles(df: DataFrame, sizes: DataFrame, key: str, item: str, rows: int) -> DataFrame:
    """Split groups of over ``rows`` rows: every pair of members meets in at least one tile.

    ``sizes`` has ``key`` and ``parts`` for groups with more than one part.  A member of part p goes
    to the tiles (p, q) and (q, p) kept with the smaller part first; other groups are one tile.
    """
    part = F.pmod(F.xxhash64(item), F.col("parts"))
    joined = df.join(sizes, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    joined = joined.withColumn("_p", part).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return (joined.withColumn("tile", F.least("_p", "_q") * F.col("parts") + F.greatest("_p", "_q"))
            .drop("_p", "_q"))
