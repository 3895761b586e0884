"""Lineage cuts that survive the loss of executors."""

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or a folder of our own where it is unset (local runs only)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = sc.getCheckpointDir()
    if have:
        return have.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="structgraph-")


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """``df`` computed once and stored reliably; the result reads the stored rows and has no lineage before them.

    A checkpoint keeps the size estimate of the plan it cut. Joined again and again in a loop, such estimates multiply into numbers
    of millions of digits, so the stored rows are taken up under a fresh estimate; adaptive execution measures real sizes anyway.
    With ``keep_layout`` the checkpoint's own plan is kept, and with it the partitioning that later joins can use. An adaptive plan does not
    know its partitioning, so this one is planned without.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    if keep_layout:
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return df.checkpoint(eager=True)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    done = df.checkpoint(eager=True)
    try:
        rows = done._jdf.queryExecution().toRdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)
    except (AttributeError, TypeError, Py4JError):  # a session without a JVM of its own
        return done


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read back; unlike a checkpoint, later readers prune its columns. The
    folder is removed when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)  # gone with the session
    return df.sparkSession.read.schema(df.schema).parquet(path)
