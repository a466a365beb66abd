"""Name -> Spark callable, name -> check SQL."""

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, *keys):
    """Deal the rows of a one-file table to all cores: the test tables are one row group each, which a
    single task would scan.  Tables of several files are left alone."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if len(df.inputFiles()) < 2 else df


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"
