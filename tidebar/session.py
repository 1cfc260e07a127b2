"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tidebar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # window-heavy tasks cost far more than their bytes suggest: keep small shuffles spread out
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        # wide feature plans hold many generated classes; no Python call sites on every expression
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """Bar boundaries are UTC by convention, whatever the session default is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session without one (tests) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidebar-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


WRITTEN: list[str] = []  # intermediate tables of this process, oldest first


def drop_tables(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables written after the first ``since`` ones; returns how many there were.

    For use once a result has been stored or collected: a result that is still lazy reads them.
    """
    gone, WRITTEN[since:] = WRITTEN[since:], []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    return len(gone)


@contextmanager
def scoped_tables(spark: SparkSession):
    """Intermediate tables written inside go at the end, whether the block succeeds or not."""
    start = len(WRITTEN)
    try:
        yield
    finally:
        drop_tables(spark, start)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and go on from the written table.

    Used where a result feeds several branches of one job: without it every branch repeats the
    work above it.  The table is columnar in the shared folder, so branches read only their
    columns, sizes are known to the planner, and lost executors cost nothing but a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidebar/{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
