"""Symbol spans: fallback ends, the innermost symbol at a line, and usage by span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that a symbol is taken to span where its end is unknown.
FALLBACK = {
    "rs": {"class": 80, "widget": 80, "method": 40, "function": 40, "enum": 25},
    "ts": {"class": 100, "widget": 100, "extension": 100, "method": 80, "function": 80, "enum": 30, "mixin": 60, "typedef": 5},
}


def with_ends(symbols: DataFrame, dialect: str = "rs", more: dict | None = None) -> DataFrame:
    """Symbols with their ends; unknown ones by kind, where ``more`` may say so otherwise."""
    extra = F.lit(0)
    for kind, n in {**FALLBACK[dialect], **(more or {})}.items():
        extra = F.when(F.col("kind") == kind, n).otherwise(extra)
    return symbols.withColumn("line_end", F.coalesce("line_end", F.col("line") + extra))


def node_at(symbols: DataFrame, cursors: DataFrame, dialect: str = "rs") -> DataFrame:
    """Innermost symbol at each (path, at): least span, of equal ones the first listed (``ord``).

    An equi-join on the path with the range as residual; the best row is taken by an aggregate, which is combined
    before the shuffle.
    """
    s = with_ends(symbols, dialect)
    hit = cursors.join(s, "path").where(F.col("at").between(F.col("line"), F.col("line_end")))
    best = F.min(F.struct((F.col("line_end") - F.col("line")).alias("span"), F.col("ord"), F.col("kind"), F.col("name"), F.col("line"), F.col("line_end"))).alias("best")
    return hit.groupBy("path", "at").agg(best).select("path", "at", "best.kind", "best.name", "best.line", "best.line_end")


def class_at(classes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Class whose lines contain ``at``; of several the one that begins last. An unknown end is open."""
    hit = cursors.join(classes, "path").where((F.col("at") >= F.col("line")) & (F.col("line_end").isNull() | (F.col("at") <= F.col("line_end"))))
    return hit.groupBy("path", "at").agg(F.max(F.struct("line", "name")).alias("best")).select("path", "at", F.col("best.name").alias("class"))
