"""Intermediate tables, kept where every executor and the driver can read them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. One of our own is set only in a local session that names none.

    On a cluster a folder of one machine can't be read by the others, so there its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Texts go to Python 2,000 rows at a time where the session has left the default of 10,000."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what is planned and run within go as soon as each run ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends here, and a lost executor costs a read.

    The shuffles behind it aren't needed again, so their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lean(spark)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._settled_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
