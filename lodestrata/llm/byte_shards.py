"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are put in one global order (digest of the text, doc_id) by a range partitioning, so equal
texts stand together and even one text that a third of all rows share is dealt over many
partitions.  Each partition's totals give the offset of the next; a group of equal texts lies at a
global byte offset and goes whole to the shard in whose target range its middle falls.  A group
larger than a target gets a shard of its own, and the other shards share the rest equally (there
are fewer such groups than shards, so the driver may hold them).

Defined results: a null text has no bytes and is grouped with the empty ones; a null doc_id sorts
first; rows that are repeated entirely get slots of their own; extra columns are ignored; an empty
table gives an empty result.  ``law`` is always ``bytes`` and ``grown_shard`` null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.store import written

_ROW = (1 << 33) - 1
#: A text of more than 1 / HOT of all rows meets its rows by a broadcast (there are fewer than HOT such texts).
HOT = 64


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    # written, since a second run of a range partitioning may cut elsewhere
    rows = written(rows.withColumn("at", at).select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(_ROW).alias("row")).drop("at"), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct("part", "row")).alias("start"))
    groups = written(groups.select("digest", "bytes", "n", "start.part", "start.row"), "shard-groups")

    giants: list = []
    while True:  # at most one round for each shard: every giant is larger than an equal share of the rest
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        rest, left = total - sum(g["bytes"] for g in giants), shards - len(giants)
        found = groups.where(F.col("bytes") * left > rest).select("digest", "bytes", "n").collect() if left > 1 else []
        if len(found) == len(giants) or len(found) >= shards:
            break
        giants = found
    own = {g["digest"]: s for s, g in enumerate(sorted(giants, key=lambda g: (-g["bytes"], g["digest"])))}
    regular = groups.where(~F.col("digest").isin(list(own))) if own else groups
    free, target = shards - len(own), max(1, rest) / max(1, shards - len(own))

    # per-partition totals (a row for each partition of the range partitioning), then prefix sums
    parts = sorted(regular.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect(), key=lambda r: r["part"])
    lines, offset, row = [], 0, 0
    for p in parts:
        lines.append((p["part"], offset, row))
        offset, row = offset + p["bytes"], row + p["n"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(lines, "part long, part_bytes long, part_rows long")
    before = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = regular.join(F.broadcast(starts), "part").select(
        "digest", "part", "row",
        (F.col("part_bytes") + F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2).alias("middle"),
        (F.col("part_rows") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first_row"),
    )
    placed = placed.withColumn("shard", (F.lit(len(own)) + F.least(F.lit(free - 1), F.floor(F.col("middle") / F.lit(target)))).cast("int"))
    placed = written(placed, "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("first_row").alias("shard_row"))  # a row for each shard
    place = placed.join(F.broadcast(firsts), "shard").select("digest", "part", "row", "shard", (F.col("first_row") - F.col("shard_row")).alias("slot0"))
    if own:
        lone = spark.createDataFrame(list(own.items()), "digest string, shard int")
        place = place.unionByName(groups.join(F.broadcast(lone), "digest").select("digest", "part", "row", "shard", F.lit(0).cast("long").alias("slot0")))

    # a row's place within its group: its global row number less the group's
    counts = sorted(rows.groupBy("part").count().collect(), key=lambda r: r["part"])
    lines, row = [], 0
    for p in counts:
        lines.append((p["part"], row))
        row += p["count"]
    base = F.broadcast(spark.createDataFrame(lines, "part long, base long"))
    rows = rows.join(base, "part").select("doc_id", "size", "text_crc32", "digest", (F.col("base") + F.col("row")).alias("number"))
    place = place.join(base, "part").select("digest", "shard", (F.col("slot0") - F.col("base") - F.col("row")).alias("shift"))
    hot = [g["digest"] for g in groups.where(F.col("n") * HOT > row).select("digest").collect()]
    often = F.col("digest").isin(hot)
    met = rows.where(~often).join(place.where(~often), "digest").unionByName(rows.where(often).join(F.broadcast(place.where(often)), "digest")) if hot else rows.join(place, "digest")
    return met.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
