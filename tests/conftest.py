import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        folder = tempfile.mkdtemp(prefix="ck-")
        session.sparkContext.setCheckpointDir(folder)
        session.conf.set("spark.checkpoint.dir", folder)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ctx(spark):
    from riskledger.plans import scan
    return scan.options(spark)


@pytest.fixture()
def corpus(spark):
    """Build corpus rows from ``(path, content)`` pairs of one scan rooted at ``/r``."""
    def make(pairs, scan_id="s", origin="workdir", tools=None):
        rows = [(scan_id, "/r", origin, p, c, len(c.encode()), "2024-03-01 00:00:00", (tools or {}).get(p, []))
                for p, c in pairs]
        df = spark.createDataFrame(rows, "scan_id string, root string, origin string, path string, content string, "
                                         "size_bytes long, modified_at string, declared_tools array<string>")
        return df.withColumn("modified_at", df.modified_at.cast("timestamp"))
    return make
