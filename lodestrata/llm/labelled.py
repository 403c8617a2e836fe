"""A bounded training sample of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id"):
    """True for the quarter of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` of the rows that are not held out: those whose ids hash lowest (ids are spread
    evenly by the hash, so this is a uniform sample that does not depend on the partitioning)."""
    return rows.where(~held_out(key) & F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key)), key).limit(most)


def one_each(rows: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """One row of each id, the least by its columns: a sample of ids is then one of as many rows, however often an id is repeated."""
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
