"""What the two vector operators share: usable vectors and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USABLE = ("vec_id is not null and embedding is not null and exists(embedding, x -> x <> 0) and "
          "forall(embedding, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false))")


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles; of rows that repeat a vec_id the smallest vector counts."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def classed(rows: DataFrame) -> DataFrame:
    """Usable vectors with ``k1, k2``, equal for equal vectors (128 bits)."""
    return rows.where(USABLE).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(7), "embedding"))


def matrix(column) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
