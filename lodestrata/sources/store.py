"""The file table as a store: latest versions, upserts, deletions, pruning, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate of structs, which is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A new version: of equal keys the row that is last in order (a change before an old row of the same time)."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, "_new"]).select(*table.columns)


def deleted(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def pruned(table: DataFrame, present: DataFrame, on: str = "path") -> DataFrame:
    """Rows whose key is still present."""
    return table.join(present.select(on).distinct(), on, "left_semi")


def changed(table: DataFrame, scan: DataFrame, on: str = "path", digest: str = "hash") -> DataFrame:
    """(key, change): added, modified and removed keys between a stored table and a scan, from one full join."""
    a, b = table.select(on, F.col(digest).alias("old")), scan.select(on, F.col(digest).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, on, "full").select(on, kind.alias("change")).where("change is not null")


def point_lookup(table: DataFrame, key: str, digest: str | None = None, on: str = "path") -> DataFrame:
    found = table.where(F.col(on) == key)
    return found if digest is None else found.where(F.col("hash") == digest)


def ring_buffer(rows: DataFrame, keys: list[str], order: list[str], size: int = 50) -> DataFrame:
    """The newest ``size`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= size)


def counted(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(name, n): rows of one of the named tables; any other name is an error."""
    if name not in tables:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(sorted(tables))}")
    return tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")


def metadata_set(table: DataFrame, entries: DataFrame) -> DataFrame:
    """A new version of a table of (key, value): the entries in place of old ones, of equal keys the greatest value."""
    fresh = entries.groupBy("key").agg(F.max("value").alias("value"))
    return deleted(table.select("key", "value"), fresh, ["key"]).unionByName(fresh)


def metadata_get(table: DataFrame, *keys: str) -> DataFrame:
    return table.where(F.col("key").isin(*keys))
