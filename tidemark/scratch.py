"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_made: list[str] = []  # what this process has named so far


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master (tests) may leave it unset, and then gets a temporary folder a session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """A point that clear() goes back to."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables made since a mark: for callers who have written what they read from them."""
    while len(_made) > since:
        remove(spark, _made.pop())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
