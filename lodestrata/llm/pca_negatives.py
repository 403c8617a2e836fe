"""Hard negatives of anchors, exactly, by an orthogonal rotation to principal axes.

A vector's components are quantised to whole numbers; a score is the inner product of two such vectors.

1. The second moments of all vectors are summed on Spark (one partial matrix for each task), and their eigenvectors, largest
   first, rotate every vector.  A rotation leaves inner products as they are and moves most of their mass to the front.
2. Products are accumulated over the leading components.  What is left of a product is at most the product of the two
   residual norms (Cauchy-Schwarz), and a slack covers the rounding of rotation and sums, so a pair has a lower and an upper bound
   at each stage.  A pair that cannot reach an anchor's least wanted score, or surely lies above a window, goes early.
3. What survives gets its inner product in whole numbers, and only those numbers decide.

The first pass finds each anchor's positives: its best rows of the same label.  The second finds for each of them the best
rows of other labels within a window of scores given as shares of the positive's score.  Rows lie in blocks in the order of their labels, anchors in
blocks of their own; every block of anchors is sent to each of a number of bins, at most one for each block of rows, and meets the blocks of rows there by
a shuffle, so no process holds all anchors, whatever the number of rows or the share of one label.  A task takes one block of anchors after the
other through the blocks of its bin and keeps the best of each anchor; their scores raise the bar for its next blocks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; ids, where several rows
have one, are not told apart, and each row counts by itself ("other" rows are those of another id); missing components of a shorter
vector count as 0; labels that are not whole numbers are compared by a 64-bit hash; other columns are ignored; an empty table gives an empty
result.  Components so large that a product might leave 55 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.store import dropped, written

#: Rows of a block, anchors of a block, and elements of one matrix of products.
ROW_BLOCK, ANCHOR_BLOCK, TILE = 8192, 1024, 1 << 20
#: Blocks of anchors whose best are held in a task before they are sent on.
HELD = 64
#: Shares of the components after which bounds are taken, and the share of pairs left from which on single pairs are followed.
STAGES, FEW = (1 / 8, 1 / 4, 1 / 2), 0.1
_EPS = float(np.finfo(np.float64).eps)
_BLOCK = "block long, lo long, hi long, n int, width int, ids binary, labels binary, q binary"


def _flat(batch, column: int, width: int) -> np.ndarray:
    """Vectors of a batch as a matrix, shorter ones filled with 0."""
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _packed(rows: DataFrame, width: int, scale: float) -> DataFrame:
    """Rows (id, label, vector) in blocks of whole numbers, in the order in which they come."""

    def run(batches):
        from pyspark import TaskContext

        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids, labels, q = (np.concatenate(x) for x in zip(*held))
            number = (task << 24) + k
            return pa.RecordBatch.from_pylist([{"block": number, "lo": int(labels.min()), "hi": int(labels.max()), "n": len(ids), "width": width, "ids": ids.tobytes(), "labels": labels.tobytes(), "q": q.tobytes()}], schema)

        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 3
        schema = pa.schema(list(zip("block lo hi n width ids labels q".split(), kinds)))
        for batch in batches:
            for a in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(a, ROW_BLOCK)
                x = np.floor(scale * _flat(part, 2, width))
                if x.size and float(np.abs(x).max()) >= (2.0**55 / width) ** 0.5:
                    raise OverflowError("components are too large for exact products in whole numbers")
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), x.astype(np.int32)))
                size += part.num_rows
                if size >= ROW_BLOCK:
                    yield block()
                    held, size, k = [], 0, k + 1
        if size:
            yield block()

    return rows.mapInArrow(run, _BLOCK)


def moments(blocks: DataFrame, width: int) -> np.ndarray:
    """Second moments of all vectors; one row of width * width numbers for each task, summed on Spark."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for q in batch.column(0):
                x = np.frombuffer(q.as_buffer(), np.int32).reshape(-1, width).astype(float)
                total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "x"])

    out = np.zeros((width, width))
    sums = blocks.select("q").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["x"].to_numpy()
    return out


def rotation(moment: np.ndarray) -> np.ndarray:
    """Orthogonal axes, those of the largest moments first."""
    if not moment.size or not np.isfinite(moment).all():
        return np.eye(len(moment))
    _, axes = np.linalg.eigh((moment + moment.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


class Side:
    """Vectors in whole numbers, rotated, with the norms of what lies behind each stage."""

    def __init__(self, ids, labels, q, axes, ends):
        self.ids, self.labels, self.q = ids, labels, q
        x = q.astype(float)
        square = np.einsum("ij,ij->i", x, x)
        self.norm, self.y = np.sqrt(square), x @ axes
        done = np.cumsum(self.y**2, axis=1)
        d = x.shape[1]
        self.rest = [np.sqrt(np.maximum(square - done[:, m - 1], 0) + 16 * (d + 8) * _EPS * square) for m in ends]

    def part(self, rows: slice) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.q, out.norm, out.y, out.rest = self.ids[rows], self.labels[rows], self.q[rows], self.norm[rows], self.y[rows], [r[rows] for r in self.rest]
        return out


def stage_ends(width: int) -> list[int]:
    return sorted({max(1, round(width * share)) for share in STAGES if width})


def slack(axes: np.ndarray) -> float:
    """Rounding of rotated products, as a share of the product of the norms."""
    d = len(axes)
    return float(np.linalg.norm(axes.T @ axes - np.eye(d))) + float(np.linalg.norm(axes @ axes.T - np.eye(d))) + 16 * (d + 8) * _EPS


def scored(a: Side, x: Side, ends: list[int], loose: float, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of x, score) of the pairs that no bound discards.

    ``wanted(low, high)`` says from matrices of bounds which pairs are still of interest and returns with them, for each
    row of ``a``, the least and the largest score of interest; the least only grows from stage to stage.
    """
    away = loose * a.norm[:, None] * x.norm + 1e-9
    before, product, alive, least, most = 0, None, None, None, None
    for k, m in enumerate(ends):
        step = a.y[:, before:m] @ x.y[:, before:m].T
        product, before = step if product is None else product + step, m
        reach = a.rest[k][:, None] * x.rest[k] + away
        alive, least, most = wanted(product - reach, product + reach)
        if alive.mean() < FEW:
            break
    i, j = np.nonzero(alive)
    product = product[i, j]
    for k in range(k + 1, len(ends)):
        m = ends[k]
        product = product + np.einsum("ij,ij->i", a.y[i, before:m], x.y[j, before:m])
        before = m
        reach = a.rest[k][i] * x.rest[k][j] + loose * a.norm[i] * x.norm[j] + 1e-9
        stays = (product + reach >= least[i]) & (product - reach <= most[i])
        i, j, product = i[stays], j[stays], product[stays]
    score = np.empty(len(i), np.int64)
    for s in range(0, len(i), TILE // 16):  # whole numbers decide
        part = slice(s, s + TILE // 16)
        score[part] = np.einsum("ij,ij->i", a.q[i[part]].astype(np.int64), x.q[j[part]].astype(np.int64))
    return i, j, score


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, owner))
    o = owner[order]
    first = np.searchsorted(o, o)
    return order[np.arange(len(o)) - first < k]


class Held:
    """The best k of each owner so far."""

    def __init__(self, owners: int, k: int):
        self.k, self.owner, self.score, self.ids = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.bar = np.full(owners, -np.inf)

    def add(self, owner, score, ids):
        owner, score, ids = np.concatenate([self.owner, owner]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        keep = best(owner, score, ids, self.k)
        self.owner, self.score, self.ids = owner[keep], score[keep], ids[keep]
        count = np.bincount(self.owner, minlength=len(self.bar))
        at = np.searchsorted(self.owner, np.flatnonzero(count >= self.k), "right") - 1
        self.bar[self.owner[at]] = self.score[at]


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row; minus infinity where it has fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def same_label_best(a: Side, x: Side, ends, loose: float, k: int, held: Held) -> None:
    """Add to ``held`` the rows of x that are among the best k of the same label for a row of a."""
    for label in np.intersect1d(a.labels, x.labels):
        mine, rows = np.flatnonzero(a.labels == label), np.flatnonzero(x.labels == label)
        for c in range(0, len(rows), ROW_BLOCK):
            right = x.part(rows[c : c + ROW_BLOCK])
            high = max(1, TILE // len(right.ids))
            for s in range(0, len(mine), high):
                own = mine[s : s + high]
                left = a.part(own)
                other = left.ids[:, None] != right.ids
                bar = held.bar[own].copy()

                def wanted(lo, up, other=other, bar=bar):
                    np.maximum(bar, kth_largest(np.where(other, lo, -np.inf), k), out=bar)
                    return other & (up >= bar[:, None]), bar, np.full(len(bar), np.inf)

                i, j, score = scored(left, right, ends, loose, wanted)
                held.add(own[i], score, right.ids[j])


def window_best(a: Side, x: Side, ends, loose: float, k: int, low: np.ndarray, high: np.ndarray, held: Held) -> None:
    """Add to ``held`` (owners: row of a * windows + window) the first k rows of x of another label within each window of a row's scores."""
    windows = low.shape[1]
    tall = max(1, TILE // max(1, len(x.ids)))
    for s in range(0, len(a.ids), tall):
        left, lo_w, up_w = a.part(slice(s, s + tall)), low[s : s + tall], high[s : s + tall]
        unlike = left.labels[:, None] != x.labels
        own = (np.arange(s, s + len(left.ids)) * windows)[:, None] + np.arange(windows)
        open_ = lo_w <= up_w
        bar = np.maximum(np.where(open_, lo_w, np.inf), held.bar[own])

        def wanted(lo, up, unlike=unlike, bar=bar, up_w=up_w, open_=open_):
            alive = np.zeros(lo.shape, bool)
            for w in range(windows):
                rows = np.flatnonzero(open_[:, w])
                if len(rows):
                    top = up_w[rows, w][:, None]
                    sure = np.where(unlike[rows] & (up[rows] <= top), lo[rows], -np.inf)
                    bar[rows, w] = np.maximum(bar[rows, w], kth_largest(sure, k))
                    alive[rows] |= unlike[rows] & (up[rows] >= bar[rows, w][:, None]) & (lo[rows] <= top)
            return alive, bar.min(axis=1), np.where(open_, up_w, -np.inf).max(axis=1)

        i, j, score = scored(left, x, ends, loose, wanted)
        for w in range(windows):
            fits = open_[i, w] & (score >= lo_w[i, w]) & (score <= up_w[i, w])
            held.add(own[i[fits], w], score[fits], x.ids[j[fits]])


def _side(batch, k: int, prefix: str, axes, ends) -> Side:
    get = lambda name, kind: np.frombuffer(batch.column(f"{prefix}{name}")[k].as_buffer(), kind)
    width = batch.column(f"{prefix}width")[k].as_py()
    return Side(get("ids", np.int64), get("labels", np.int64), get("q", np.int32).reshape(-1, width), axes, ends)


def _met(anchors: DataFrame, blocks: DataFrame, bins: int, same: bool) -> DataFrame:
    """Blocks of anchors (columns a_) and of rows (x_) that meet; with ``same`` only where their labels overlap.

    By a shuffle on the bin in any case: the written anchors look small enough for a broadcast, which would hold them once for each bin.
    """
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    right = blocks.select(*[F.col(c).alias(f"x_{c}") for c in blocks.columns], F.pmod(F.hash("block"), F.lit(bins)).alias("bin"))
    overlap = (F.col("a_lo") <= F.col("x_hi")) & (F.col("x_lo") <= F.col("a_hi"))
    met = left.repartition(bins, "bin").hint("merge").join(right.repartition(bins, "bin"), "bin")
    return met.where(overlap) if same else met


def positives(anchors: DataFrame, blocks: DataFrame, axes: np.ndarray, bins: int, k: int) -> DataFrame:
    """(block, place, anchor_id, positive_id, positive_score): the first k other rows of an anchor's label."""
    ends, loose = stage_ends(len(axes)), slack(axes)
    names = ["block", "place", "anchor_id", "positive_id", "positive_score"]

    def run(batches):
        held: dict[int, tuple[Side, Held]] = {}

        def sent(number):
            a, h = held.pop(number)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h.owner), number)), pa.array(h.owner), pa.array(a.ids[h.owner]), pa.array(h.ids), pa.array(h.score)], names)

        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column("a_block")[r].as_py()
                if number not in held:
                    if len(held) >= HELD:
                        yield sent(next(iter(held)))
                    a = _side(batch, r, "a_", axes, ends)
                    held[number] = a, Held(len(a.ids), k)
                a, h = held[number]
                same_label_best(a, _side(batch, r, "x_", axes, ends), ends, loose, k, h)
        for number in list(held):
            yield sent(number)

    found = _met(anchors, blocks, bins, True).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    first = Window.partitionBy("block", "place").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def negatives(anchors: DataFrame, blocks: DataFrame, axes: np.ndarray, bins: int, k: int, per: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(block, place, slot, negative_id, negative_score) of anchors with their positives' scores; slots are the places of ``scores`` of each anchor."""
    ends, loose = stage_ends(len(axes)), slack(axes)
    names = ["block", "place", "slot", "negative_id", "negative_score"]

    def run(batches):
        held: dict[int, tuple] = {}

        def sent(number):
            h = held.pop(number)[-1]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h.owner), number)), pa.array(h.owner // per), pa.array(h.owner % per), pa.array(h.ids), pa.array(h.score)], names)

        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column("a_block")[r].as_py()
                if number not in held:
                    if len(held) >= HELD:
                        yield sent(next(iter(held)))
                    a = _side(batch, r, "a_", axes, ends)
                    lo, up = np.ones((len(a.ids), per), np.int64), np.zeros((len(a.ids), per), np.int64)
                    for x in batch.column("a_scores")[r].as_py():
                        s = x["positive_score"]
                        lo[x["place"], x["rank"] - 1], up[x["place"], x["rank"] - 1] = -(-low[0] * s // low[1]), high[0] * s // high[1]
                    held[number] = a, lo, up, Held(len(a.ids) * per, k)
                a, lo, up, h = held[number]
                window_best(a, _side(batch, r, "x_", axes, ends), ends, loose, k, lo, up, h)
        for number in list(held):
            yield sent(number)

    found = _met(anchors, blocks, bins, False).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    first = Window.partitionBy("block", "place", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("negative_rank", F.row_number().over(first)).where(F.col("negative_rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives_each: int = 5, negatives_each: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: float = 256.0, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (rows where ``is_anchor``, an expression of ``key`` named ``id``) and each of its first positives, the first rows of other labels whose score lies
    between ``low`` and ``high`` (numerator, denominator) of the positive's.
    """
    spark = rows.sparkSession
    whole = rows.schema[label].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    code = F.col(label).cast("long") if whole else F.xxhash64(label)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    taken = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), code.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    taken = taken.where(~F.exists("vector", bad))
    width = max(1, int(taken.agg(F.max(F.size("vector"))).first()[0] or 0))
    # like labels lie together, whatever their share
    blocks = written(_packed(taken.repartitionByRange(F.col("label"), F.col("id")).sortWithinPartitions("label", "id"), width, scale), "vectors")
    axes = rotation(moments(blocks, width))
    bins = max(1, min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()))
    anchors = written(_anchor_blocks(taken.where(is_anchor), width, scale), "anchors")
    found = written(positives(anchors, blocks, axes, bins, positives_each), "positives")
    scores = found.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "positive_score")).alias("scores"))
    asked = anchors.join(scores.hint("merge"), "block")
    got = written(negatives(asked, blocks, axes, bins, negatives_each, positives_each, low, high), "negatives")
    out = got.withColumn("rank", F.col("slot") + 1).join(found.hint("merge"), ["block", "place", "rank"])
    out = written(out.select("anchor_id", "positive_id", F.col("negative_rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    dropped(blocks, anchors, found, got)
    return out


def _anchor_blocks(anchors: DataFrame, width: int, scale: float) -> DataFrame:
    """Blocks of at most ANCHOR_BLOCK anchors, in the order of their labels."""
    whole = _packed(anchors.repartitionByRange(F.col("label"), F.col("id")).sortWithinPartitions("label", "id"), width, scale)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["q"], np.int32).reshape(-1, width)
                for k, a in enumerate(range(0, row["n"], ANCHOR_BLOCK)):
                    part = slice(a, a + ANCHOR_BLOCK)
                    cut = {"block": (row["block"] << 8) + k, "lo": int(labels[part].min()), "hi": int(labels[part].max()), "n": len(ids[part])}
                    yield pa.RecordBatch.from_pylist([row | cut | {"ids": ids[part].tobytes(), "labels": labels[part].tobytes(), "q": q[part].tobytes()}], batch.schema)

    return whole.mapInArrow(run, _BLOCK)
