"""Session defaults for local runs; a cluster brings its own session."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus or '8'}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("RISKLEDGER_MEMORY", "8g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several branches read.

    Uses the reliable checkpoint folder the session names in ``spark.checkpoint.dir``.
    Without one the frame is returned as it is and branches recompute it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a Parquet table in that folder: a checkpoint is not packed."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
