"""Corpus, log and report sources; the contract sink."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.catalog.contract_schema import report_ddl
from riskledger.functions import paths, signals as G, text as T

def read_files(spark: SparkSession, root: str, scan_id: str, origin: str = "workdir",
               name_glob: str | None = None) -> DataFrame:
    """Files below ``root`` as corpus rows.  ``name_glob`` is applied while listing, before any
    content is read; length and time filters on the result are pushed down as well."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    return reader.load(root).select(
        F.lit(scan_id).alias("scan_id"), F.lit(root.rstrip("/")).alias("root"), F.lit(origin).alias("origin"),
        path.alias("path"), "content", F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"))


def read_lines(spark: SparkSession, root: str, scan_id: str, origin: str = "workdir",
               name_glob: str | None = None) -> DataFrame:
    """``scan_id, root, origin, path, line, text``: numbered lines of files of any size.

    A large file is read in ranges of ``spark.sql.files.maxPartitionBytes`` by many tasks, so that no file has
    to be one value; a line has.  Line ends are ``\\n`` and ``\\r\\n``, bytes that are no UTF-8 are replaced.
    Lines are numbered from the number of lines in each range: these counts are the only thing that is
    brought together, in a first pass.  The files must not change while they are read.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    rows = reader.text(root).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"),
                                    F.monotonically_increasing_id().alias("at"))
    ranges = rows.groupBy("file_path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("start")) - F.col("n")
    numbered = rows.join(ranges.select("file_path", "start", "first", before.alias("before")), ["file_path", "start"])
    text = T.utf8_text(F.col("value"))
    plain = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    return numbered.select(
        F.lit(scan_id).alias("scan_id"), F.lit(root.rstrip("/")).alias("root"), F.lit(origin).alias("origin"),
        F.regexp_replace(plain, r"^file:/*(?=/)", "").alias("path"),
        (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"),
        F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text).alias("text"))


def read_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """A stored Parquet inventory in corpus form."""
    return spark.read.parquet(folder)


def log_texts(files: DataFrame, now=None, max_age_days: int | None = None) -> DataFrame:
    """Relevant log files with their whole ``text``; bytes that are no UTF-8 are replaced.

    With ``max_age_days``, files older than that at ``now`` (a timestamp column) are left out.
    """
    rows = files.where(G.log_name_relevant(F.substring_index("path", "/", -1)))
    if max_age_days is not None:
        rows = rows.where(F.col("modified_at") > now - F.make_dt_interval(F.lit(max_age_days)))
    return rows.withColumn("text", T.utf8_text(F.col("content")))


def log_lines(files: DataFrame, home=None) -> DataFrame:
    """``scan_id, ts, log_name, text`` of each relevant log file, as the log operators read them.

    ``log_name`` is the path as evidence may show it: below ``home`` it starts with ``~``, elsewhere
    it is the file name.
    """
    home = F.lit(None).cast("string") if home is None else home
    return log_texts(files).select("scan_id", F.col("modified_at").alias("ts"),
                                   paths.scrub_home(F.col("path"), home).alias("log_name"), "text")


def write_payloads(payloads: DataFrame, folder: str) -> None:
    """Contract documents as text, one line each, partitioned by scan."""
    payloads.select("scan_id", F.col("payload").alias("value")).write.mode("overwrite") \
        .partitionBy("scan_id").text(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Saved contract documents with all their fields; the read fails on the first one that does not parse."""
    return spark.read.schema(report_ddl()).option("mode", "FAILFAST").json(folder)
