"""Tables built once and read by many searches, kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets its own, on a cluster its absence is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def written(frame: DataFrame, name: str, *by: str, path: str | None = None, append: bool = False) -> DataFrame:
    """``frame`` as Parquet in the shared folder (or at ``path``), partitioned by columns ``by``, read again."""
    spark = frame.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.mode("append" if append else "errorifexists").partitionBy(*by).parquet(path)
    out = spark.read.parquet(path)
    out._kept_at = path
    return out


def state_of(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """What tells a table from a later one at the same path: its length and the time of its last change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return path, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


_kept: dict[tuple, dict[str, str]] = {}


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of an index named ``name`` over the tables at ``sources``: built by the first caller in this application, read by
    all later ones, built anew once a source has changed. ``build`` returns tables made by written()."""
    key = (spark.sparkContext.applicationId, name, *(state_of(spark, s) for s in sources))
    if key not in _kept:
        _kept[key] = {k: v._kept_at for k, v in build().items()}
    return {k: spark.read.parquet(path) for k, path in _kept[key].items()}
