"""Quality classifier: a factorisation machine.

Inputs of a score are the hashed words of the text, statistics of its structure, and metadata of the
text itself (sizes).  The model has a weight and a vector of ``RANK`` factors for each feature; pairwise
interactions are scored in linear time, since sum_{i<j} <v_i, v_j> x_i x_j equals half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on at most ``TRAIN_ROWS`` labelled documents (the lowest id hashes among those not held
out), collected as sparse features of bounded size; scoring takes every whole text and is one pass
without a shuffle.

Defined results: null and empty texts are scored by their (zero) features; several labels of a
document count by their mean, null labels not at all; without any labels to learn from every score
is 1; of rows with the same id the least by its features teaches, and repeated rows are scored alike; other columns are ignored by the query and kept by the
filter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.labelled import held_out, one_each, sample

TRAIN_ROWS, RANK, EPOCHS, ACCEPT = 6000, 8, 12, 0.7
WORD_BITS = 13
N_WORDS = 1 << WORD_BITS
#: Each statistic is spread over a few soft bins, so that a linear part can bend.
KNOTS = 8

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 6
_CLASS[[ord(c) for c in "|<>{}[]=\\/_~^`"]] = 7
_CLASS[[ord(c) for c in "!#$%&*+@"]] = 8
STATISTICS = ("upper", "lower", "digit", "space", "high", "point", "code", "symbol", "length", "words", "word_length", "repeat", "distinct", "lines", "symbol_end", "odd_case")
N_STATS = len(STATISTICS)
N_FEATURES = N_WORDS + N_STATS * KNOTS


def _log_unit(x, top):
    return np.minimum(np.log1p(x) / np.log1p(top), 1)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk: for each text its feature numbers and values, as (first, index, value)."""
    n = len(offs) - 1
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 9 + _CLASS[buf], minlength=9 * n).reshape(n, 9) if n else np.zeros((0, 9))
    starts, ends, first = K.words(buf, offs)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    h = K.span_hash(buf, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    per = lambda flags: np.bincount(owner[flags], minlength=n) / np.maximum(count, 1)
    last = _CLASS[buf[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    second = _CLASS[buf[np.minimum(starts + 1, np.maximum(ends - 1, 0))]] if len(ends) else np.zeros(0, np.uint8)
    keys, times = np.unique((owner.astype(np.int64) << WORD_BITS) | (h >> K.U(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    rows, cells = keys >> WORD_BITS, keys & (N_WORDS - 1)
    of = np.maximum(size, 1)[:, None]
    lines = np.bincount(doc[buf == 10], minlength=n) if len(buf) else np.zeros(n)
    stats = np.column_stack([
        *(kinds[:, [1, 2, 3, 4, 5, 6, 7, 8]] / of).T, _log_unit(size, 1e6), _log_unit(count, 1e5), np.minimum((size / np.maximum(count, 1)) / 20, 1),
        per(same), np.bincount(rows, minlength=n) / np.maximum(count, 1), _log_unit(lines, 1e4), per(last >= 7), per(second == 1),
    ])
    place = np.clip(stats, 0, 1) ** 0.5 * (KNOTS - 1)
    low = np.minimum(place.astype(int), KNOTS - 2)
    share = place - low
    base = N_WORDS + np.arange(N_STATS) * KNOTS + low
    word = times / np.sqrt(np.maximum(np.bincount(rows, times.astype(float) ** 2, minlength=n), 1))[rows]
    r = np.concatenate([rows, np.repeat(np.arange(n), 2 * N_STATS)])
    i = np.concatenate([cells, np.stack([base, base + 1], 2).reshape(-1)])
    v = np.concatenate([word, np.stack([1 - share, share], 2).reshape(-1)])
    order = np.argsort(r, kind="stable")
    return np.searchsorted(r[order], np.arange(n + 1)), i[order].astype(np.int32), v[order].astype(np.float32)


def margins(model: dict, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Linear-time scores of sparse rows (each has at least its statistics)."""
    if len(first) < 2:
        return np.zeros(0)
    at = first[:-1]
    vx = model["v"][index] * value[:, None]
    linear = np.add.reduceat(model["w"][index] * value, at)
    total, squares = np.add.reduceat(vx, at), np.add.reduceat(vx * vx, at)
    return model["bias"] + linear + 0.5 * (total * total - squares).sum(1)


def _sparse(docs: DataFrame) -> DataFrame:
    """quality, and the sparse row of each text as bytes."""

    def run(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(1))
            for a, b in K.chunks(offs):
                first, i, v = features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                cut = lambda x: [x[p:q].tobytes() for p, q in zip(first[:-1], first[1:])]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(cut(i), pa.binary()), pa.array(cut(v), pa.binary())], ["doc_id", "quality", "i", "v"])

    return docs.select("doc_id", "text", "quality").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, i binary, v binary")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, seed: int = 7) -> dict | None:
    """Fit on at most ``most`` labelled documents; None without any."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    ids = sample(known, most)  # bounded, so it may be broadcast
    # the ids of a sample may miss in docs (a stage gets what its predecessors kept)
    rows = one_each(_sparse(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")), "quality", "i", "v").orderBy("doc_id").collect()
    if not rows:
        return None
    first = np.cumsum([0] + [len(r["i"]) // 4 for r in rows])
    index, value = np.frombuffer(b"".join(r["i"] for r in rows), np.int32), np.frombuffer(b"".join(r["v"] for r in rows), np.float32)
    y = np.array([r["quality"] for r in rows])
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK)), 0.0
    gw, gv, gb = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3), 1e-3
    # classes count alike; otherwise the rarer one would be scored low throughout
    weight = np.where(y >= 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) if 0 < y.mean() < 1 else np.ones(len(y))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for some in np.array_split(order, max(1, len(y) // 64)):
            take = np.concatenate([np.arange(first[d], first[d + 1]) for d in some])
            size = first[some + 1] - first[some]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            i, x = index[take], value[take].astype(float)
            vx = v[i] * x[:, None]
            total, squares = np.add.reduceat(vx, at), np.add.reduceat(vx * vx, at)
            z = bias + np.add.reduceat(w[i] * x, at) + 0.5 * (total * total - squares).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)
            gx = np.repeat(g, size) * x
            dw = np.bincount(i, gx, N_FEATURES) + 1e-5 * w
            dv = np.column_stack([np.bincount(i, gx * (np.repeat(total[:, f], size) - vx[:, f]), N_FEATURES) for f in range(RANK)]) + 1e-5 * v
            gw += dw * dw
            gv += dv * dv
            gb += g.sum() ** 2
            w -= 0.1 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
            bias -= 0.1 * g.sum() / gb**0.5
    return {"w": w.astype(np.float32), "v": v.astype(np.float32), "bias": float(bias)}


def score_texts(model: dict | None, column: pa.Array) -> np.ndarray:
    buf, offs = K.utf8(column)
    if model is None:
        return np.ones(len(offs) - 1)
    out = [np.zeros(0)]
    for a, b in K.chunks(offs, K.CHUNK // 2):
        out.append(margins(model, *features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])))
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            s = score_texts(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= accept).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows, with all their columns, whose text is accepted."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, batch.column(at)) >= accept))

    return docs.mapInArrow(run, docs.schema)
