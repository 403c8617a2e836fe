"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct four-word shingles; two link at a Jaccard similarity of at least ``NUM / DEN``.

1. Documents of equal sets form one class (128-bit digest of the set).
2. MinHash.  ``SAMPLES`` samples of each class in ``BANDS`` bands of ``ROWS``.  Linked sets agree in a band with a chance of at least
   0.8^4, so in 26 of 64 on average.  Bands are counted over the whole corpus.  A class that shares fewer than ``SHARED`` bands with anyone
   links with nobody; any other is looked up under all its shared bands but the SHARED - 1 most common ones.  A link is overlooked only
   if two linked sets agree in fewer than SHARED = 6 bands, a chance of at most 3e-9 each (binomial tail at 0.8).
3. Odd sketch.  The samples are folded into ``BITS`` bits, each sample flipping one, so samples that two sets share cancel
   out in the XOR of their sketches.  Its population count estimates the number of differing samples, and so the similarity, best
   where it is high; ``estimate`` gives it.  Candidates with a count beyond ``CUT`` are left out: at a similarity of 0.8 the count is 84 on average with a deviation of
   11, so a linked pair is left out with a chance below 1e-8, and a pair at 0.5 nearly always.  The shingles themselves are folded in the same way: where the
   XOR of two such sketches has more than (a + b) / 9 bits, sets of a and b shingles surely differ in more of them than a link allows.
4. The full sets of what is left are compared, and that alone decides.

Which pairs are tried: first each class against the most central member of its ``STARS`` most common buckets; then, for as long as such rounds join many,
members outside the main class of a bucket against one member of it and one of the others, drawn by hash, in ``DRAWS`` of their buckets each; then those against
all others of their bucket, each pair in the least bucket that both have.  Buckets with more than ``PAIRS`` of
these pairs would grow as a product; their members meet by single shingles instead, by a prefix filter, which is exact: ordered by how few of these members hold
them, linked sets of n shingles have one in common among the first n - ceil(4n/5) + 1.  A passage that very many documents share comes last in that order, so it
brings only those together that consist of it.  There is no cap on buckets, partners or candidates.

Keys that hold at least 1 / 2^16 of all rows (2^16 keys at most) meet their counts by a broadcast; the others are shuffled by key, of which none is
larger than that.

Defined results: a text without words, or null, has no set, links with nothing and is kept; repeated doc_ids are one document each by
its text and share the id; ties go to the least doc_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.components import components
from lodestrata.llm.parity_join import digest
from lodestrata.llm.store import dropped, written

NUM, DEN, WIDTH = 4, 5, 4
SAMPLES, ROWS = 256, 4
BANDS, SHARED = SAMPLES // ROWS, 6
BITS, CUT = 512, 150
#: Pairs of members outside the main class with others beyond which a bucket is looked up by shingles; ids that may be broadcast, and the share that makes a key common.
PAIRS, BROADCAST_IDS, COMMON = 1 << 14, 1 << 20, 1 << 16
#: Buckets of a class in the first round, rounds of drawn members at most, buckets of a member in each, and keys of a node that tell where a pair is made.
STARS, ROUNDS, DRAWS, KEYS = 4, 3, 2, 64
ODD, FOLDED = [f"k{i}" for i in range(BITS // 64)], [f"s{i}" for i in range(BITS // 64)]

_rng = np.random.default_rng(0x0DD)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of each set; sets are not empty."""
    out = np.empty((SAMPLES, len(sets)), np.uint32)
    tokens = np.concatenate(sets)
    x = (tokens ^ (tokens >> K.U(32))).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    y = np.empty_like(x)
    for k in range(SAMPLES):
        np.bitwise_xor(x, _XOR[k], out=y)
        np.multiply(y, _TIMES[k], out=y)
        y ^= y >> np.uint32(15)
        np.minimum.reduceat(y, starts, out=out[k])
    return out.T


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One key for each band."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=K.U), (len(samples), BANDS))
    for r in range(ROWS):
        h = K.mix(h) + samples[:, r::ROWS]
    return K.mix(h).view(np.int64)


def _parities(bit: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    odd = np.bincount((bit & K.U(BITS - 1)).astype(np.int64) + owner * BITS, minlength=owners * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(owners, -1)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Each sample flips one of BITS bits."""
    bit = K.mix(samples.astype(K.U) + (np.arange(SAMPLES, dtype=K.U) << K.U(32)))
    return _parities(bit.ravel(), np.repeat(np.arange(len(samples)), SAMPLES), len(samples))


def folded(sets: list[np.ndarray]) -> np.ndarray:
    """Each shingle flips one of BITS bits."""
    return _parities(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets]), len(sets))


def estimate(differing_bits) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    p = np.minimum(np.asarray(differing_bits, float), BITS / 2 - 1)
    return np.maximum(0, 1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * p / BITS))


def members(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), sid (digest of the set), bands and odd sketch; the latter two only where a task meets the set for the first time."""
    names = ["doc_id", "n", "sid", "bands", *ODD, *FOLDED]

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            buf, offs = K.utf8(batch.column(1))
            for a, b in K.chunks(offs):
                sets = K.shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], WIDTH)
                sids = [digest(t) if len(t) else None for t in sets]
                fresh = []
                for k, sid in enumerate(sids):
                    if sid is not None and sid not in seen:
                        fresh.append(k)
                        if len(seen) < 1 << 20:
                            seen.add(sid)
                columns = [pa.nulls(len(sets), pa.list_(pa.int64()))] + [pa.nulls(len(sets), pa.int64())] * (2 * len(ODD))
                if fresh:
                    own = [sets[k] for k in fresh]
                    s = samples_of(own)
                    where = np.full(len(sets), -1)
                    where[fresh] = np.arange(len(fresh))
                    take = pa.array(where, mask=where < 0)
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(fresh) + 1, dtype=np.int32) * BANDS), pa.array(bands_of(s).ravel()))
                    columns = [bands.take(take), *[pa.array(c).take(take) for side in (odd_sketches(s), folded(own)) for c in side.T]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in sets], pa.int64()), pa.array(sids, pa.binary()), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, sid binary, bands array<long>, " + ", ".join(f"{c} long" for c in (*ODD, *FOLDED)))


def with_holders(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key several have, with the number of its holders; ``rows`` must be cheap to read twice."""
    counts = written(rows.groupBy(key).agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
    total = int(counts.agg(F.sum("holders")).first()[0] or 0)
    common = counts.where(F.col("holders") * COMMON >= total)  # at most COMMON keys
    met = rows.join(F.broadcast(common), key, "left")
    other = met.where("holders is null").drop("holders").join(counts.where(F.col("holders") * COMMON < total), key)
    return met.where("holders is not null").unionByName(other)


def set_blobs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tokens (packed set) of the classes (node, rep, sid)."""

    def run(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(0))
            for a, b in K.chunks(offs):
                got = [(a + k, t) for k, t in enumerate(K.shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], WIDTH)) if len(t) and digest(t) == batch.column(2)[a + k].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([k for k, _ in got], pa.int64())), pa.array([t.tobytes() for _, t in got], pa.binary())], ["node", "tokens"])

    side = nodes.select(F.col("rep").alias("_rep"), "node", "sid")
    side = F.broadcast(side) if nodes.count() <= BROADCAST_IDS else side
    rows = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_rep")))
    return rows.select("text", "node", "sid").mapInArrow(run, "node long, tokens binary")


def confirmed(pairs: DataFrame, blobs: DataFrame, salt_rows: int = 4096) -> DataFrame:
    """Those of the pairs (u, v) whose full sets link; a u that very many pairs have is salted."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(salt_rows)).cast("int").alias("salts"))
    left = many.join(blobs.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u").select("u", "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = pairs.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt")).join(blobs.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep[k] = DEN * same >= NUM * (len(a) + len(b) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    return right.join(left, ["u", "salt"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _near(a: str, b: str):
    """Sizes and sketches do not exclude a link; the columns of either side begin with its letter."""
    apart = lambda keys: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}_{k}").bitwiseXOR(F.col(f"{b}_{k}"))) for k in keys])
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (n * NUM <= m * DEN) & (m * NUM <= n * DEN) & (apart(FOLDED) * (NUM + DEN) <= (n + m) * (DEN - NUM)) & (apart(ODD) <= CUT)


def _side(rows: DataFrame, letter: str, *more: str) -> DataFrame:
    return rows.select(F.col("node").alias(letter), *[F.col(c).alias(f"{letter}_{c}") for c in ("n", *ODD, *FOLDED, *more)])


def candidates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that their sketches do not exclude."""
    return pairs.join(_side(nodes, "v"), "v").join(_side(nodes, "u"), "u").where(_near("u", "v")).select("u", "v")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, class) after the classes that links (u, v) join have become one."""
    side = lambda c: label.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class"))
    between = links.join(side("u"), "u").join(side("v"), "v").where("u_class != v_class").select(F.col("u_class").alias("u"), F.col("v_class").alias("v"))
    found = components(between).withColumnsRenamed({"id": "class"})
    return written(label.join(found, "class", "left").select("node", F.coalesce("component", "class").alias("class")), "label")


def mixed(entries: DataFrame, label: DataFrame) -> DataFrame:
    """Entries (key, node), with their class, of keys under which several classes meet, with the largest class (main) and how many pairs of a member outside it and any other the key has."""
    rows = entries.select("key", "node").join(label, "node")
    main = rows.groupBy("key", "class").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "class")).alias("top"), F.count("*").alias("some"), F.sum("k").alias("members")).where("some > 1")
    return rows.join(main.select("key", F.col("top.class").alias("main"), ((F.col("members") - F.col("top.k")) * F.col("members")).alias("pairs")), "key")


def drawn(rows: DataFrame, turn: int) -> DataFrame:
    """(u, v) of ``mixed`` rows: members outside a key's main class with one member of that class and one of the others, drawn by hash, in some keys of each."""
    one = lambda some: some.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)), "node")).getField("node").alias("u"))
    some = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key", F.lit(turn)), "key"))
    out = rows.where("class != main").withColumn("some", some).where(F.col("some") <= DRAWS)
    heads = one(rows.where("class = main")).unionByName(one(rows.where("class != main")))
    return out.select("key", F.col("node").alias("v")).join(heads, "key").where("u != v").select("u", "v").distinct()


def unlike(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different classes that meet under a key of ``mixed`` rows and that no sketch excludes, made under the least key that both have.

    Of a node with more than KEYS keys the first KEYS tell this, so its pairs may be made several times.
    """
    keys = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, KEYS).alias("keys"))
    full = rows.join(nodes.select("node", "n", *ODD, *FOLDED).join(keys, "node"), "node")
    u, v = (_side(x, c, "key", "class", "main", "keys") for x, c in ((full.where("class != main"), "u"), (full, "v")))
    # two outsiders meet twice: keep one order
    apart = (F.col("u_class") != F.col("v_class")) & ((F.col("v_class") == F.col("v_main")) | (F.col("u") < F.col("v")))
    first = F.coalesce(F.array_min(F.array_intersect("u_keys", "v_keys")), F.col("u_key")) >= F.col("u_key")
    met = u.join(v, (F.col("u_key") == F.col("v_key")) & apart & _near("u", "v") & first)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def prefix_entries(blobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node): the shingles under which the nodes meet, by the prefix filter over all these nodes."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                t = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), batch.column(0)[k].as_py())), pa.array(np.full(len(t), len(t))), pa.array(t)], ["node", "n", "key"])

    tokens = written(blobs.join(nodes, "node", "left_semi").select("node", "tokens").mapInArrow(run, "node long, n long, key long"), "hot-shingles")
    mine = Window.partitionBy("node")
    looked = with_holders(tokens, "key").withColumn("alone", F.col("n") - F.count("*").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("holders", "key")))
    return looked.where(F.col("rank") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).select("key", "node")


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, class of the sets that may link with others, after all links."""
    banded = written(classes.select("node", F.explode("bands").alias("key")), "bands")
    mine = Window.partitionBy("node")
    looked = with_holders(banded, "key").withColumn("shared", F.count("*").over(mine)).where(F.col("shared") >= SHARED)
    looked = looked.withColumn("central", F.sum(F.log2("holders")).over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("holders", "key")))
    looked = looked.withColumn("common", F.col("rank") > F.col("shared") - STARS).withColumn("kept", F.col("rank") <= F.col("shared") - SHARED + 1).where("common or kept")
    entries = written(looked.select("key", "node", "common", "kept", F.struct((F.col("central") * 1000).cast("long").alias("by"), F.col("node")).alias("central")), "entries")
    dropped(banded)
    nodes = written(classes.drop("bands").join(entries.select("node").distinct(), "node", "left_semi"), "involved")
    blobs = written(set_blobs(docs, nodes), "sets")
    if not blobs.groupBy("node").count().where("count > 1").isEmpty():  # rows that repeat
        blobs, every = written(blobs.dropDuplicates(["node"]), "sets"), blobs
        dropped(every)

    label = nodes.select("node", F.col("node").alias("class"))
    common = entries.where("common")
    heads = common.groupBy("key").agg(F.max("central").getField("node").alias("u"))
    stars = common.select("key", F.col("node").alias("v")).join(heads, "key").where("u != v").select("u", "v").distinct()
    label, _, _ = _joined(label, stars, nodes, blobs)
    kept = entries.where("kept")
    met = written(mixed(kept, label), "mixed")
    for turn in range(ROUNDS):
        label, asked, linked = _joined(label, drawn(met, turn), nodes, blobs)
        if linked:
            met, before = written(mixed(kept, label), "mixed"), met
            dropped(before)
        if 10 * linked < asked or not asked:
            break
    pairs = [unlike(met.where(F.col("pairs") <= PAIRS), nodes)]
    hot = written(met.where(F.col("pairs") > PAIRS).select("node").distinct(), "hot")
    if not hot.isEmpty():
        by_shingle = written(prefix_entries(blobs, hot), "prefixes")
        pairs.append(unlike(mixed(by_shingle, label), nodes))
    pairs = written(pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1]).distinct(), "pairs")
    links = written(confirmed(pairs, blobs), "links-rest")
    if not links.isEmpty():
        label, before = _merged(label, links), label
        dropped(before)
    dropped(met, pairs, links, entries, blobs, hot)
    return label


def _joined(label: DataFrame, pairs: DataFrame, nodes: DataFrame, blobs: DataFrame) -> tuple[DataFrame, int, int]:
    """The label after the links among the pairs (u, v), and how many v were asked and found a link."""
    pairs = written(pairs, "asked")
    near = written(candidates(pairs, nodes), "near")
    links = written(confirmed(near, blobs), "links")
    asked, linked = (x.select("v").distinct().count() for x in (pairs, links))
    if linked:
        label, before = _merged(label, links), label
        dropped(before)
    dropped(pairs, near, links)
    return label, asked, linked


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (whether that is the row's own) of every row."""
    rows = written(members(docs), "members")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("bands", *ODD, *FOLDED)]
    classes = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), *first)
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    label = linked_classes(docs, classes)
    named = classes.select("sid", "node", "rep", "copies").join(label, "node", "left")
    least = named.where("class is not null").groupBy("class").agg(F.min("rep").alias("least"))
    # a set that one row has and that links with nothing needs no lookup
    several = written(named.where("class is not null or copies > 1").join(least, "class", "left").select("sid", F.coalesce("least", "rep").alias("component_id")), "several")
    side = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    dropped(classes, label)
    out = rows.select("doc_id", "n", "sid").join(side, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
