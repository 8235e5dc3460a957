"""A folder that the driver and all executors share, for tables between steps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, or under an own one where that is unset and all runs on this machine; it goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        base = _own[app]
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def saved(df: DataFrame, what: str) -> DataFrame:
    """df, written once and read again: what several jobs use is computed by one, and a lost executor costs tasks and no lineage."""
    path = f"{shared_folder(df.sparkSession, what)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
