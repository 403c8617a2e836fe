"""Table access for the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: whole texts go to Python, and the default of 10,000 rows would make batches of tens of MB.
#: Spark itself cuts a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has set its own."""
    if spark.conf.get(_KEY, _DEFAULT) == _DEFAULT:
        spark.conf.set(_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
