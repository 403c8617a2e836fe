"""Intermediate tables, written to the folder that all executors share and deleted when nothing reads them any more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of this application, in local runs only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lodestrata-steps-")
    return _own_dirs[app]


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """A written copy: later plans start from its files, so a lost executor costs no earlier step."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._files_of = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables; anything else is left alone."""
    for df in tables:
        if path := getattr(df, "_files_of", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
