"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles; two link at a Jaccard similarity of at least
``NUM / DEN``.  All links that matter for the connected classes are found exactly:

1. Documents of equal sets form one class (128-bit digest of the set), which has a number of its own.
2. Sketch.  A set's tokens are dealt by hash into ``p`` blocks and each block is the XOR of its tokens'
   hashes, so that the number of blocks in which two sets differ is a lower bound of their symmetric
   difference.  ``p`` belongs to a band of set sizes; a set takes part in its own band and, where a partner
   could be small enough, in the band below.
3. Pigeonhole.  Sets that link differ in at most d = size / 3 tokens, so they agree on at least
   q = (non-empty blocks) - d blocks.  Block sketches are counted over the whole corpus; a set that
   shares fewer than q block sketches with anyone links with nobody, and any other set needs to be looked up
   only under the (shared - q + 1) rarest of them: two linked sets have one of these in common, since
   the order by rarity is the same for both.  A passage that very many documents have is therefore
   looked up only by those that consist of it for the most part.
4. Verify.  First every member of a bucket against its most central member (the one whose sketches are
   the most common), then the members outside the bucket's main class against one member of it and
   one of their own, which each of some buckets draws by another hash, for as long as such rounds join many; a round is
   linear in the buckets.  What is still in several classes is compared in full: in the join itself a pair must pass the size filter and
   the Hamming distance of two 512-bit parity sketches, which again bounds the symmetric
   difference, and is left out where a smaller sketch that both have is seen (among the ``LOW`` smallest of each).  Pairs
   within one class are never made.

Holders of a sketch are counted in parts: where a task meets a sketch ``HOT`` times or more, it sends the
number to the sketch's bucket and the holders elsewhere, so that a passage which a third of all documents
have does not fill one bucket; the sum is joined back.  Sums of parts may count copies of a set again, which changes
the order by rarity for all alike and nothing else.

A set whose tokens meet in so few blocks that q < 1 (out of reach of chance, as sets of fewer than
``SMALL`` tokens use their tokens as blocks) is looked up by its tokens: linked sets have one in common among
the quarter of least hash, of both (``token_pairs``).

Defined results: a text without words, or null, has no set and links with nothing; repeated doc_ids are
one document each by its text and share the id; other columns are ignored by the join and kept by the
filter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.components import components
from lodestrata.llm.store import dropped, written

NUM, DEN, WIDTH = 3, 4, 5
SMALL = 64
#: Band k >= 1 holds sizes from SMALL * 2^(k-1) below SMALL * 2^k; its blocks are this share of the upper size.
SHARE_LOW, SHARE_HIGH = 1.0, 0.6
SKETCH_LONGS = 8
#: Block sketches handled at once in the counting step, and ids that may be broadcast.
BUCKET_SKETCHES, BROADCAST_IDS = 1 << 21, 1 << 20
#: A sketch is looked up within its bucket only, where so many bytes leave few chance meetings (and those cost
#: a candidate, never a result).
_SKETCH_BYTES = 5
_HEAD = np.dtype([("eid", "<i8"), ("count", "<u2")])
_SUM = np.dtype([("sketch", "<i8"), ("count", "<u4")])
#: Holders of a sketch in one task from which on only their number goes to the bucket; rounds of drawn heads, one in so
#: many buckets that draws; and sketches of a set that tell whether a pair is made elsewhere.
HOT, ROUNDS, DRAWN, LOW = 16, 4, 8, 32


def band_of(n: int) -> int:
    return 0 if n < SMALL else (n // SMALL).bit_length()


def blocks_of(band: int) -> int:
    top = SMALL << band
    return round(top * (SHARE_LOW if top <= 8 * SMALL else SHARE_HIGH))


def least_partner(n: int) -> int:
    return -(-NUM * n // DEN)


def most_apart(n: int, band: int) -> int:
    """Largest symmetric difference of a set of n tokens and a partner, where the smaller one is in the band.

    With sizes a <= b and |A & B| >= 3/4 |A or B|: the difference is at most (a + b) / 7.
    """
    small = n if band_of(n) == band else min(n, (SMALL << band) - 1)
    large = n * DEN // NUM if band_of(n) == band else n
    return (small + large) * (DEN - NUM) // (DEN + NUM)


def block_sketches(tokens: np.ndarray, band: int) -> np.ndarray:
    """One hash for each non-empty block of a sorted set, saying band, block and XOR."""
    if band == 0:
        return K.mix(tokens ^ K.U(0xA5A5A5A5))
    block = ((tokens >> K.U(32)) * K.U(blocks_of(band))) >> K.U(32)  # grows with the token: blocks are contiguous
    at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return K.mix(np.bitwise_xor.reduceat(K.mix(tokens), at) ^ K.mix(block[at] + K.U(band << 40)))


def entries_of(tokens: np.ndarray):
    """(band, block sketches, q) for each band that the set takes part in."""
    n = len(tokens)
    for band in range(band_of(least_partner(n)), band_of(n) + 1):
        s = block_sketches(tokens, band)
        yield band, s, len(s) - most_apart(n, band)


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """512 bits: each token flips one."""
    bits = np.bincount((tokens & K.U(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batch, column: int):
    """(row, set) of a batch, chunk by chunk."""
    buf, offs = K.utf8(batch.column(column))
    for a, b in K.chunks(offs):
        for k, tokens in enumerate(K.shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], WIDTH)):
            yield a + k, tokens


def entry_id(sid: bytes, band: int) -> int:
    """A set in a band."""
    return xxhash.xxh3_64_intdigest(sid, band) - (1 << 63)


def memberships(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, n (set size), sid (digest of the set; null without one), and the entry id and q of its one or two bands."""
    names = ["doc_id", *more, "n", "sid", "e0", "q0", "e1", "q1"]

    def run(batches):
        for batch in batches:
            rows = []
            for _, t in _sets(batch, len(more) + 1):
                sid = digest(t) if len(t) else None
                bands = [x for band, s, q in entries_of(t) for x in (entry_id(sid, band), q)] if sid else []
                rows.append((len(t), sid, *bands, *[None] * (4 - len(bands))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(more) + 1], *[pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])]], names)

    taken = docs.select("doc_id", *more, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{kinds}, n long, sid binary, e0 long, q0 long, e1 long, q1 long")


def packed_sketches(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, heads, low, sums): all block sketches, dealt by hash and packed.

    ``heads`` has entry ids with their numbers of sketches, ``low`` the low bytes of the sketches and ``sums`` the
    sketches of which only the number of holders is sent; buckets from ``buckets`` on hold these holders (entry
    ids and names of sketches), dealt evenly.  A set that occurs again in the same task is left out, so
    copies do not add up before the shuffle.
    """
    names, most = ["bucket", "heads", "low", "sums"], HOT

    def run(batches):
        seen: set[bytes] = set()

        def flush(eids, parts):
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            sketch = np.concatenate(parts)
            bucket = ((sketch >> K.U(32)) * K.U(buckets) >> K.U(32)).astype(np.int64)
            order = np.argsort(sketch, kind="stable")  # buckets grow with the sketch
            owner, sketch, bucket = owner[order], sketch[order], bucket[order]
            low = np.ascontiguousarray(sketch).view(np.uint8).reshape(-1, 8)[:, :_SKETCH_BYTES]
            at = np.flatnonzero(np.concatenate(([True], sketch[1:] != sketch[:-1])))
            often = np.diff(np.append(at, len(sketch)))
            hot = np.repeat(often >= most, often)
            sums = np.zeros((often >= most).sum(), _SUM)
            sums["sketch"], sums["count"] = _widened(low[at[often >= most]]), often[often >= most]
            of_sums = bucket[at[often >= most]]
            eids = np.array(eids, np.int64)
            rows = []
            if hot.any():
                name = _named(_widened(low[hot]), bucket[hot])
                rows.append((buckets + int(eids[0] % buckets), eids[owner[hot]].tobytes(), name.tobytes(), None))
            owner, low, bucket = owner[~hot], low[~hot], bucket[~hot]
            cuts, ends = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(of_sums, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts) + np.diff(ends)).tolist():
                mine = slice(cuts[k], cuts[k + 1])
                by = np.argsort(owner[mine], kind="stable")
                who, count = np.unique(owner[mine], return_counts=True)
                heads = np.zeros((-(-count // 65535)).sum(), _HEAD)  # a very large set takes several lines
                heads["eid"] = eids[np.repeat(who, -(-count // 65535))]
                heads["count"] = _lines(count)
                rows.append((k, heads.tobytes(), low[mine][by].tobytes(), sums[ends[k] : ends[k + 1]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names)

        eids, parts, size = [], [], 0
        for batch in batches:
            for _, tokens in _sets(batch, 0):
                if not len(tokens) or (sid := digest(tokens)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(sid)
                for band, sketch, _ in entries_of(tokens):
                    eids.append(entry_id(sid, band))
                    parts.append(sketch)
                    size += len(sketch)
                if size > 1 << 19:
                    yield flush(eids, parts)
                    eids, parts, size = [], [], 0
        if size:
            yield flush(eids, parts)

    return docs.select("text").mapInArrow(run, "bucket int, heads binary, low binary, sums binary")


def _lines(count: np.ndarray) -> np.ndarray:
    """Counts cut in lines of at most 65535."""
    if (count <= 65535).all():
        return count
    return np.concatenate([[65535] * (c // 65535) + [c % 65535] * (c % 65535 > 0) for c in count.tolist()])


def _widened(low: np.ndarray) -> np.ndarray:
    """The low bytes of sketches as numbers."""
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :_SKETCH_BYTES] = low
    return full.view(np.int64)[:, 0]


def _named(low: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The sketches of a bucket by names that differ from those of other buckets."""
    return K.mix(low.view(K.U) ^ K.mix(bucket.astype(K.U))).view(np.int64)


def shared_sketches(packed: DataFrame, buckets: int) -> DataFrame:
    """Block sketches that two or more sets have: eid, sketch, holders.

    Where numbers of holders came, a row without eid has the sum, and rows without ``holders`` have those who hold the sketch.
    """
    names = ["eid", "sketch", "holders"]

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        joined = lambda name, kind: np.frombuffer(b"".join(x.as_buffer() for x in table.column(name) if x.is_valid), kind)
        if bucket >= buckets:
            owner, name = joined("heads", np.int64), joined("low", np.int64)
            return pa.Table.from_arrays([pa.array(owner), pa.array(name), pa.nulls(len(owner), pa.int64())], names)
        heads, sums = joined("heads", _HEAD), joined("sums", _SUM)
        sketch = _widened(joined("low", np.uint8).reshape(-1, _SKETCH_BYTES))
        owner = np.repeat(heads["eid"], heads["count"])
        hot, where = np.unique(sums["sketch"], return_inverse=True)
        total = np.bincount(where, sums["count"], len(hot)).astype(np.int64)
        order = np.argsort(sketch, kind="stable")
        sketch, owner = sketch[order], owner[order]
        same = sketch[1:] == sketch[:-1]
        often = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(sketch) else np.zeros(0, bool)
        often |= np.isin(sketch, hot)
        sketch, owner = sketch[often], owner[often]
        # the same set may have come from several tasks
        order = np.lexsort((owner, sketch))
        sketch, owner = sketch[order], owner[order]
        fresh = np.ones(len(sketch), bool)
        fresh[1:] = (sketch[1:] != sketch[:-1]) | (owner[1:] != owner[:-1])
        sketch, owner = sketch[fresh], owner[fresh]
        at = np.flatnonzero(np.concatenate(([True], sketch[1:] != sketch[:-1]))) if len(sketch) else np.zeros(0, np.int64)
        holders = np.diff(np.append(at, len(sketch)))
        also = np.searchsorted(sketch[at], hot)
        met = np.append(sketch[at], -1)[also] == hot
        total[met] += holders[also[met]]
        summed = np.zeros(len(at), bool)
        summed[also[met]] = True
        holders, summed = np.repeat(holders, holders), np.repeat(summed, holders)
        keep = summed | (holders > 1)
        name = _named(np.concatenate([sketch[keep], hot]), np.full(1, bucket))
        eid = pa.concat_arrays([pa.array(owner[keep]), pa.nulls(len(hot), pa.int64())])
        count = pa.concat_arrays([pa.array(holders[keep], mask=summed[keep]), pa.array(total)])
        return pa.Table.from_arrays([eid, pa.array(name), count], names)

    return packed.groupBy("bucket").applyInArrow(run, "eid long, sketch long, holders long")


def counted(docs: DataFrame, sketches: int) -> DataFrame:
    """eid, sketch, holders of all shared block sketches, once each."""
    buckets = max(8, -(-sketches // BUCKET_SKETCHES))
    shared = written(shared_sketches(packed_sketches(docs, buckets).repartition(min(2 * buckets, 1 << 14), "bucket"), buckets), "shared")
    sums = written(shared.where("eid is null").select("sketch", "holders"), "sums")
    some = sums.count()
    if not some:
        return shared
    hot = shared.where("holders is null").select("eid", "sketch").distinct().join(F.broadcast(sums) if some <= BROADCAST_IDS else sums, "sketch")
    return shared.where("eid is not null and holders is not null").unionByName(hot)


def set_blobs(chosen: DataFrame) -> DataFrame:
    """node, tokens (packed set) and the 512-bit sketch of the rows (doc_id, text, node, sid) that have the set ``sid``."""
    sketch = [f"k{i}" for i in range(SKETCH_LONGS)]

    def run(batches):
        for batch in batches:
            got = [(k, t) for k, t in _sets(batch, 0) if len(t) and digest(t) == batch.column(2)[k].as_py()]
            bits = np.array([parity_sketch(t) for _, t in got], np.int64).reshape(-1, SKETCH_LONGS)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([k for k, _ in got], pa.int64())), pa.array([t.tobytes() for _, t in got], pa.binary()), *[pa.array(bits[:, i]) for i in range(SKETCH_LONGS)]], ["node", "tokens", *sketch])

    return chosen.select("text", "node", "sid").mapInArrow(run, "node long, tokens binary, " + ", ".join(f"{c} long" for c in sketch))


def linked(pairs: DataFrame, blobs: DataFrame, salt_rows: int = 4096) -> DataFrame:
    """Those of the pairs (u, v) that link.  v should be spread; a u that very many pairs have is salted."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(salt_rows)).cast("int").alias("salts"))
    left = many.join(blobs.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u").select("u", "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"))
    right = salted.join(blobs.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v")
    both = right.join(left, ["u", "salt"]).select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = batch.column(2)[k].as_buffer(), batch.column(3)[k].as_buffer()
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                same = len(a) + len(b) - len(np.union1d(a, b))
                keep[k] = DEN * same >= NUM * (len(a) + len(b) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(run, "u long, v long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text, node, sid: the rows that may have the sets of classes (node, rep, sid)."""
    side = nodes.select(F.col("rep").alias("_rep"), F.col("node"), F.col("sid"))
    side = F.broadcast(side) if nodes.count() <= BROADCAST_IDS else side
    return docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("doc_id", "text", "node", "sid")


def token_pairs(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Pairs (u, v) of classes that may link, where q < 1 for one of them; None without such a class.

    By a prefix filter on the tokens: in the order of their hashes, linked sets of sizes a and b have a token in common
    among the first a - ceil(3a/4) + 1 and b - ceil(3b/4) + 1.
    """
    few = classes.where("q0 < 1 or q1 < 1")
    if few.isEmpty():
        return None
    few = written(few.select("node", "rep", "sid", "n"), "few-blocks")
    sizes = few.select(F.explode(F.sequence(F.ceil(F.col("n") * NUM / DEN), F.floor(F.col("n") * DEN / NUM))).alias("n")).distinct()
    near = written(classes.join(sizes, "n", "left_semi").select("node", "rep", "sid"), "near-sizes")

    def run(batches):
        for batch in batches:
            for k, t in _sets(batch, 0):
                if len(t) and digest(t) == batch.column(2)[k].as_py():
                    first = t[: len(t) - least_partner(len(t)) + 1].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), batch.column(1)[k].as_py())), pa.array(first)], ["node", "token"])

    tokens = lambda nodes: _rows_of(docs, nodes).select("text", "node", "sid").mapInArrow(run, "node long, token long")
    met = tokens(few).withColumnRenamed("node", "u").join(tokens(near).withColumnRenamed("node", "v"), "token").where("u != v")
    return written(_ordered(met.select("u", "v")), "token-pairs")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, class) after the classes that links (u, v) join have become one."""
    side = lambda c: label.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class"))
    between = links.join(side("u"), "u").join(side("v"), "v").where("u_class != v_class")
    found = components(between.select(F.col("u_class").alias("u"), F.col("v_class").alias("v"))).withColumnsRenamed({"id": "class"})
    return written(label.join(found, "class", "left").select("node", F.coalesce("component", "class").alias("class")), "label")


def _sizes(a: str, b: str):
    return (F.col(a) * NUM <= F.col(b) * DEN) & (F.col(b) * NUM <= F.col(a) * DEN)


def _mixed(entries: DataFrame, label: DataFrame) -> DataFrame:
    """Entries, with their class, of the buckets that hold several classes, and the bucket's largest class (``main``)."""
    rows = entries.select("sketch", "node", "n").join(label, "node")
    main = rows.groupBy("sketch", "class").agg(F.count("*").alias("k")).groupBy("sketch").agg(F.max(F.struct("k", "class")).getField("class").alias("main"), F.count("*").alias("some"))
    return rows.join(main.where("some > 1").select("sketch", "main"), "sketch")


def _unlike(mixed: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pairs of different classes that share a bucket and that no bound tells apart."""
    keys = [f"k{i}" for i in range(SKETCH_LONGS)]
    low = mixed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sketch")), 1, LOW).alias("low"))
    full = mixed.join(low.join(blobs.drop("tokens"), "node"), "node")
    side = lambda rows, x: rows.select(F.col("sketch").alias(f"{x}_sketch"), F.col("main").alias(f"{x}_main"), *[F.col(c).alias(f"{x}{c}") for c in ("node", "n", "class", "low", *keys)])
    u, v = side(full.where("class != main"), "u"), side(full, "v")
    apart = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in keys[1:]), F.bit_count(F.col("uk0").bitwiseXOR(F.col("vk0"))))
    # two outsiders meet twice: keep one order
    near = (F.col("uclass") != F.col("vclass")) & ((F.col("vclass") == F.col("v_main")) | (F.col("unode") < F.col("vnode"))) & _sizes("un", "vn") & (apart * (NUM + DEN) <= F.col("un") + F.col("vn"))
    least = F.array_min(F.array_intersect("ulow", "vlow"))
    first = F.coalesce(least, F.col("u_sketch")) >= F.col("u_sketch")
    return _ordered(u.join(v, (F.col("u_sketch") == F.col("v_sketch")) & near & first).select(F.col("unode").alias("u"), F.col("vnode").alias("v")))


def set_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, class of the sets that may link with others, after all links."""
    total = int(classes.agg(F.sum("n")).first()[0] or 0)
    of = classes.select("node", "n", F.explode(F.array(F.struct(F.col("e0").alias("eid"), F.col("q0").alias("q")), F.struct(F.col("e1").alias("eid"), F.col("q1").alias("q")))).alias("e"))
    of = of.select("node", "n", "e.eid", "e.q").where("eid is not null")
    mine = Window.partitionBy("eid")
    looked = counted(docs, total).join(of, "eid").withColumn("shared", F.count("*").over(mine)).where("shared >= q")
    looked = looked.withColumn("central", F.sum(F.log2("holders")).over(mine) / F.col("n"))
    looked = looked.withColumn("rank", F.row_number().over(mine.orderBy("holders", "sketch"))).where("rank <= shared - greatest(q, 1) + 1")
    # the order of centrality is that of a number that also holds the node
    entries = written(looked.select("sketch", "node", "n", F.struct((F.col("central") * 1000).cast("long").alias("by"), F.col("node")).alias("central")), "entries")
    extra = token_pairs(docs, classes)

    nodes = entries.select("node")
    nodes = nodes if extra is None else nodes.union(extra.select("u")).union(extra.select("v"))
    involved = written(classes.select("node", "rep", "sid").join(nodes.distinct(), "node", "left_semi"), "involved")
    blobs = written(set_blobs(_rows_of(docs, involved)), "sets")
    if not blobs.groupBy("node").count().where("count > 1").isEmpty():  # rows that repeat
        blobs, every = written(blobs.dropDuplicates(["node"]), "sets"), blobs
        dropped(every)

    label = involved.select("node", F.col("node").alias("class"))
    heads = entries.groupBy("sketch").agg(F.max("central").getField("node").alias("u"))
    stars = written(entries.select("sketch", F.col("node").alias("v")).join(heads, "sketch").where("u != v").select("u", "v").distinct(), "stars")
    links = written(linked(stars, blobs), "links-star")
    label = _merged(label, links)
    dropped(stars, links)
    mixed = written(_mixed(entries, label), "mixed")
    for turn in range(ROUNDS):
        some = mixed.where(F.pmod(F.xxhash64("sketch", F.lit(turn)), F.lit(DRAWN)) == 0)
        drawn = lambda rows, turn=turn: rows.groupBy("sketch").agg(F.min(F.struct(F.xxhash64("node", "sketch", F.lit(turn)), "node")).getField("node").alias("u"))
        out = some.where("class != main")
        heads = drawn(some.where("class = main")).unionByName(drawn(out))
        pairs = written(out.select("sketch", F.col("node").alias("v")).join(heads, "sketch").where("u != v").select("u", "v").distinct(), "pairs-drawn")
        links = written(linked(pairs, blobs), "links-drawn")
        asked, joined = pairs.select("v").distinct().count(), links.select("v").distinct().count()
        if joined:
            dropped(mixed)
            label, before = _merged(label, links), label
            mixed = written(_mixed(entries, label), "mixed")
            dropped(before)
        dropped(pairs, links)
        if 10 * joined < asked or not asked:
            break
    pairs = _unlike(mixed, blobs)
    pairs = written(pairs if extra is None else _ordered(pairs.unionByName(extra)), "pairs")
    links = written(linked(pairs, blobs), "links-rest")
    if not links.isEmpty():
        label = _merged(label, links)
    dropped(mixed, pairs, links, entries, blobs)
    return label


def jaccard_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, n_shingles, component_id of every row, and ``class``, which is equal for linked rows (null without a set)."""
    members = written(memberships(docs, *more), "members")
    classes = members.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n", "e0", "q0", "e1", "q1")])
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    label = set_classes(docs, classes)
    named = classes.select("sid", "node", "rep", "copies").join(label, "node", "left")
    least = named.where("class is not null").groupBy("class").agg(F.min("rep").alias("least"))
    # a set that one row has and that links with nothing needs no lookup
    several = named.where("class is not null or copies > 1").join(least, "class", "left").select("sid", F.coalesce("least", "rep").alias("component_id"), F.coalesce("class", "node").alias("class"))
    several = written(several, "several")
    side = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    dropped(classes, label)
    out = members.join(side, "sid", "left")
    return out.select("doc_id", *more, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "sid", "class")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the least doc_id reachable by links."""
    return jaccard_rows(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns: of each class one row of the least doc_id (of its texts the one of least hash; of rows equal in
    doc_id and text any one), and all rows without a set."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = jaccard_rows(keyed, "_text").where("sid is not null")
    many = written(rows.where("class is not null").select("class", "doc_id", "_text"), "copies")
    kept = many.groupBy("class").agg(F.min(F.struct("doc_id", "_text")).alias("kept"))
    gone = many.join(kept, "class").where(~F.struct("doc_id", "_text").eqNullSafe(F.col("kept"))).select("doc_id", "_text").distinct()
    gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")), "gone")
    again = written(many.groupBy("doc_id", "_text").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")), "again")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of"))
    some = gone.count()
    # the row is one column, so that none of its names meets those of the join
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    left = rows.join(F.broadcast(gone) if some <= BROADCAST_IDS else gone, same, "left_anti")
    if not again.isEmpty():
        twice = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_text"])
        left = left.join(again, same, "left_anti").unionByName(twice)
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
