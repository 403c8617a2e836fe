"""Document fingerprints: SimHash with permuted block tables.

Terms are runs of three lower-cased words (all words as one term, where a text has fewer).  Each distinct term
votes with weight 1 + log2(occurrences), in whole units so that sums are exact and a tie is a tie on every machine, for
the bits of its hash; a bit is set where the signed sum of the votes is positive.  ``neighbours`` finds all pairs of distinct fingerprints within a Hamming
radius: the 64 bits are cut in radius + keep blocks, and two fingerprints within the radius agree on
at least ``keep`` of these whole, so each table is keyed by one choice of ``keep`` blocks.

Defined results: a null text is empty; a text without words has the fingerprint 0; equal texts have
equal fingerprints; a null doc_id sorts first and rows of equal doc_id by text; an empty table gives
an empty result; the one row of a one-row table is its own next document.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.store import written

TERM_WORDS, BITS, RADIUS, KEEP = 3, 64, 3, 2
#: Units of a vote of weight 1.
UNIT = 1024
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.float64) * 2) - 1
#: Documents in one range of the order that gives each its next one.
RANGE_ROWS = 1024
#: Ranges at most; beyond that they get longer (rows stream through them, sorted by Spark).
MOST_RANGES = 8192
#: Ranges of one partition on average: several small ones even out; and fingerprints that may be broadcast.
RANGES_EACH, BROADCAST_PRINTS = 4, 1 << 20


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SimHash of each text as uint64."""
    out = np.zeros(len(offs) - 1, np.uint64)
    for a, b in K.chunks(offs):
        lo, hi = offs[a], offs[b]
        part, at = buf[lo:hi], offs[a : b + 1] - lo
        starts, ends, first = K.words(part, at)
        h = K.span_hash(part, starts, ends)
        runs = K.run_hash(h, TERM_WORDS)
        for d, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if j == i:
                continue
            terms = runs[i : j - TERM_WORDS + 1] if j - i >= TERM_WORDS else K.run_hash(h[i:j], j - i)
            terms, n = np.unique(terms, return_counts=True)
            weight = np.round((1 + np.log2(n)) * UNIT)
            votes = np.empty(BITS)
            for k, column in enumerate(terms.view(np.uint8).reshape(-1, 8).T):
                votes[8 * k : 8 * k + 8] = np.bincount(column, weight, 256) @ _SIGNS
            out[a + d] = np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint_docs(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) of every row; no shuffle."""

    def run(batches):
        for batch in batches:
            fp = fingerprints(*K.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{x:016x}" for x in fp.tolist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _block(bits, k: int, n: int):
    lo, hi = round(BITS * k / n), round(BITS * (k + 1) / n)
    return F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def block_tables(prints: DataFrame, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """(t, k, bits): each distinct fingerprint once in every table, under the key of the table's blocks."""
    n = radius + keep
    classes = prints.where("fingerprint is not null").select("fingerprint").distinct()
    classes = classes.select(F.conv("fingerprint", 16, -10).cast("long").alias("bits"))
    keys = [F.struct(F.lit(t).cast("byte").alias("t"), F.xxhash64(*[_block(F.col("bits"), k, n) for k in ks]).alias("k")) for t, ks in enumerate(combinations(range(n), keep))]
    return classes.select("bits", F.explode(F.array(*keys)).alias("key")).select("key.t", "key.k", "bits")


def neighbours(prints: DataFrame, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """Pairs a < b of distinct fingerprints (hex) that differ in 1 to ``radius`` bits, with the distance.

    Equal fingerprints are one class; their documents are found by equality.  The distance is tested
    in the join itself, so no pair beyond the radius is made a row; a pair is kept from the first
    table that finds it only.
    """
    n = radius + keep
    rows = block_tables(prints, radius, keep)
    a, b = (rows.select(F.col("t").alias(f"{x}_t"), F.col("k").alias(f"{x}_k"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    gap = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    same = [_block(F.col("a_bits"), k, n) == _block(F.col("b_bits"), k, n) for k in range(n)]
    first = F.lit(-1)
    for t, ks in reversed(list(enumerate(combinations(range(n), keep)))):
        first = F.when(reduce(lambda x, y: x & y, [same[k] for k in ks]), F.lit(t)).otherwise(first)
    name = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    found = a.join(b, (F.col("a_t") == F.col("b_t")) & (F.col("a_k") == F.col("b_k")) & (name("a_bits") < name("b_bits")) & (gap <= radius) & (first == F.col("a_t")))
    return found.select(name("a_bits").alias("a"), name("b_bits").alias("b"), gap.alias("distance"))


def with_neighbours(prints: DataFrame, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """fingerprint of those that have another one within the radius: a semi-join, which makes no pairs."""
    rows = block_tables(prints, radius, keep)
    a, b = (rows.select(F.col("t").alias(f"{x}_t"), F.col("k").alias(f"{x}_k"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    near = (F.col("a_t") == F.col("b_t")) & (F.col("a_k") == F.col("b_k")) & (F.col("a_bits") != F.col("b_bits")) & (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= radius)
    return a.join(b, near, "left_semi").select(F.lower(F.lpad(F.hex("a_bits"), 16, "0")).alias("fingerprint")).distinct()


def _edges_up_to(edges: list[int], x):
    """How many of the sorted edges are at most x (0 for null), by binary search."""
    if not edges:
        return F.lit(0)
    table = F.lit(edges)

    def halve(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        right = open_ & F.coalesce(F.element_at(table, F.least(middle + 1, F.lit(len(edges)))) <= x, F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, middle).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(edges).bit_length())), start, halve, lambda acc: acc["lo"])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last quarter is replaced by the
    beginning of the next document.

    One shuffle of the texts: ranges of the doc_id order are found from the ids alone, and the first
    text of each range is sent to the range before it as well.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id")
    n = ids.count()
    cuts = max(1, min(-(-n // RANGE_ROWS), MOST_RANGES))
    # cuts by value: with an id that is repeated very often a range is large, but results are the same
    edges = ids.approxQuantile("doc_id", [k / cuts for k in range(1, cuts)], 0.2 / cuts) if cuts > 1 else []
    edges = sorted({int(x) for x in edges})
    spark = docs.sparkSession
    rank = _edges_up_to(edges, F.col("doc_id"))
    firsts = {r["range"]: r["doc_id"] for r in ids.select("doc_id", rank.alias("range")).groupBy("range").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("nulls")).select("range", F.when(~F.col("nulls"), F.col("doc_id")).alias("doc_id")).collect()}
    if not firsts:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = sorted(firsts)
    # the first row of each range also ends the range before; that of the first range ends the last
    ends = [(firsts[r], order[i - 1]) for i, r in enumerate(order)]
    ends = spark.createDataFrame(ends, f"first {kind}, before int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rank.alias("range"))
    parts = max(2, len(order) // RANGES_EACH)
    marked = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    sent = marked.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(False).alias("next")))).otherwise(F.array(F.struct("range", F.lit(False).alias("next")), F.struct(F.col("before").alias("range"), F.lit(True).alias("next"))))).alias("to"))
    sent = sent.select("doc_id", "text", "to.range", "to.next").repartition(parts, "range").sortWithinPartitions("range", "next", "doc_id", "text")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held: list = []  # rows of which the next one is still to come: one

        def results(rows):
            """rows: (doc_id, text, range, next) in order; those with a successor in their range."""
            pairs, texts, edited = [], [], []
            for x, y in zip(rows, rows[1:]):
                if not x[3] and x[2] == y[2]:
                    k = len(x[1]) // 4
                    pairs.append((x[0], len(x[1])))
                    texts += [x[1], y[1]]
                    edited.append(x[1][: len(x[1]) - k] + y[1][:k] if k else x[1])
            if not pairs:
                return None
            kept, number, where = [], [], {}
            for t in texts:  # a text and its successor's are mostly neighbours: hash each once
                if id(t) not in where:
                    where[id(t)] = len(kept)
                    kept.append(t)
                number.append(where[id(t)])
            fp = fingerprints(*K.utf8(pa.array(kept, pa.large_string())))[number]
            ed = fingerprints(*K.utf8(pa.array(edited, pa.large_string())))
            mine, following = fp[0::2], fp[1::2]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], id_type[0]), pa.array([p[1] for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([f"{x:016x}" for x in mine.tolist()], pa.string()), pa.array([f"{x:016x}" for x in ed.tolist()], pa.string()),
                    pa.array(likeness(mine, ed)), pa.array(likeness(mine, following)),
                ], names)

        id_type = [None]
        for batch in batches:
            id_type[0] = batch.column(0).type
            size = 0
            rows = held
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not (row[3] and rows and rows[-1][3] and rows[-1][2] == row[2]):  # repeated rows of the first id: the first of them
                    rows.append(row)
                    size += len(row[1])
                if size > 4 << 20:
                    if (out := results(rows)) is not None:
                        yield out
                    rows, size = rows[-1:], 0
            if (out := results(rows)) is not None:
                yield out
            held = rows[-1:]

    return sent.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def searched_fingerprints(docs: DataFrame) -> DataFrame:
    """edited_fingerprints() with ``near_other``: another fingerprint of the corpus lies within the radius."""
    rows = written(edited_fingerprints(docs), "fingerprints")
    # written: a join of two plain exchanges can split a fingerprint that very many documents have
    near = written(with_neighbours(rows).withColumn("near_other", F.lit(True)), "near")
    side = F.broadcast(near) if near.count() <= BROADCAST_PRINTS else near
    return rows.join(side, "fingerprint", "left").select(*rows.columns, F.coalesce("near_other", F.lit(False)).alias("near_other"))
