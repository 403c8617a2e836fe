"""Language identification by error-correcting output codes.

Each language has a binary codeword.  One classifier per code bit tells the languages whose bit is 1
from the others: it sums the log odds of the hashed letter n-grams (lengths 2 to 4, of
lower-cased UTF-8 bytes, over letters and single gaps).  Decoding weights each bit by how well its
classifier did in training, and chooses the codeword with the least loss; ``ambiguous`` marks texts
where the second codeword is nearly as close.

Fitted on at most ``TRAIN_ROWS`` documents that are not held out; predictions take whole texts in one
pass without a shuffle.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where no document
teaches a language; documents with a null language teach nothing, and
of rows with the same id the least by language and n-grams does; ties go to the first language by
name; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.labelled import held_out, one_each, sample
from lodestrata.llm.store import dropped, written

TRAIN_ROWS, HASH_BITS, UNDECIDED, MARGIN = 4000, 15, "und", 0.15
N_CELLS = 1 << HASH_BITS
LENGTHS = (2, 3, 4)
#: n-grams that count as independent evidence at most: those of a text are far from independent.
EVIDENCE = 60.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +-1: the exhaustive code up to 6 languages, random rows of 15 log2(n) bits beyond."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:  # every split of the languages once: the first language always has 1
        bits = [c for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([[1] * len(bits), *zip(*bits)], float)
    rng, width = np.random.default_rng(seed), math.ceil(15 * math.log2(n))
    best = max((rng.choice((-1.0, 1.0), (n, width)) for _ in range(200)), key=lambda c: -(c @ c.T - 2 * width * np.eye(n)).max())
    return best[:, np.abs(best.sum(0)) < n]


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash cell of every n-gram of a chunk."""
    n = len(buf)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[buf]
    upper = np.zeros(n, bool)  # capitals of Latin-1 in UTF-8
    upper[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    b = np.where(upper, b + 32, b).astype(np.uint32)
    gap = ~_LETTER[buf]
    b[gap] = 32
    double = np.zeros(n, bool)
    double[1:] = gap[1:] & gap[:-1]
    runs = np.concatenate(([0], np.cumsum(double)))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    docs, cells = [], []
    code = b.copy()
    for length in range(2, max(LENGTHS) + 1):
        m = n - length + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + b[length - 1 :]
        fits = (doc[:m] == doc[length - 1 :]) & (runs[length:] == runs[1 : m + 1])
        h = (code[:m] * np.uint32(0x9E3779B1)) ^ np.uint32(length * 0x85EBCA6B % 2**32)
        cells.append((h[fits] * np.uint32(0xC2B2AE35) >> np.uint32(32 - HASH_BITS)).astype(np.int64))
        docs.append(doc[:m][fits])
    return np.concatenate(docs), np.concatenate(cells)


def bit_margins(log_odds: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean log odds of each bit, times the evidence of the text."""
    n = len(offs) - 1
    doc, cell = ngrams(buf, offs)
    count = np.bincount(doc, minlength=n)
    sums = np.column_stack([np.bincount(doc, log_odds[cell, k], n) for k in range(log_odds.shape[1])])
    return sums / np.maximum(count, 1)[:, None] * np.minimum(count, EVIDENCE)[:, None]


def fit(docs: DataFrame, most: int = TRAIN_ROWS) -> dict | None:
    ids = sample(docs.where("lang is not null").select("doc_id"), most)
    rows = docs.where("lang is not null").select("doc_id", "text", "lang").join(F.broadcast(ids.distinct()), "doc_id")

    def count(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(1))
            for a, b in K.chunks(offs):
                doc, cell = ngrams(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                cuts = np.searchsorted(doc_sorted := doc[order := np.argsort(doc, kind="stable")], np.arange(b - a + 1))
                assert len(doc_sorted) == len(cell)
                cell = cell[order]
                counts = []
                for p, q in zip(cuts[:-1], cuts[1:]):
                    found, times = np.unique(cell[p:q], return_counts=True)
                    counts.append(found.astype(np.int32).tobytes() + times.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts, pa.binary())], ["doc_id", "lang", "counts"])

    got = rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, counts binary")
    kept = written(one_each(got, "lang", "counts"), "language-sample")
    langs = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    if not langs:
        dropped(kept)
        return None
    code = codewords(len(langs))
    table = np.zeros((len(langs), N_CELLS))

    def read():
        """Language number, cells and counts of each document; the driver holds one partition of the sample at a time."""
        for r in kept.orderBy("doc_id").toLocalIterator():
            yield langs.index(r["lang"]), *np.frombuffer(r["counts"], np.int32).reshape(2, -1)

    for k, cell, n in read():
        # a document teaches frequencies, not more the longer it is
        table[k][cell] += n / max(1, n.sum()) * 200
    share = (table + 0.02) / (table + 0.02).sum(1, keepdims=True)
    one = code.T[:, :, None] > 0
    p1 = (share * one).sum(1) / np.maximum(1, one.sum(1))
    p0 = (share * ~one).sum(1) / np.maximum(1, (~one).sum(1))
    odds = np.log(p1 + 1e-12) - np.log(p0 + 1e-12) if len(langs) > 1 else np.zeros((1, N_CELLS))
    hits = [(odds[:, c] @ t / max(1, t.sum()) > 0) == (code[k] > 0) for k, c, t in read()]
    dropped(kept)
    right = np.mean(hits, 0)
    weight = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return {"langs": langs, "code": code, "odds": np.ascontiguousarray(odds.T), "weight": weight / weight.sum()}


def decode(model: dict, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity: the loss of a codeword is the weighted logistic loss of its bits."""
    loss = (np.logaddexp(0, -margin[:, None, :] * model["code"][None]) * model["weight"]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, 1)
    return best, p[np.arange(len(p)), best], (top[:, -1] - top[:, -2] < MARGIN) if p.shape[1] > 1 else np.zeros(len(p), bool)


def _lettered(texts, buf, offs) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum(_LETTER[buf] & (buf < 128))))
    found = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in (texts[int(i)].as_py() or ""))
    return found


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    model = fit(docs)

    def run(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(2))
            n = batch.num_rows
            lang, score, unsure = np.full(n, UNDECIDED, object), np.zeros(n), np.ones(n, bool)
            if model is not None:
                known = _lettered(batch.column(2), buf, offs)
                for a, b in K.chunks(offs, K.CHUNK // 2):
                    best, p, near = decode(model, bit_margins(model["odds"], buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                    k = known[a:b]
                    lang[a:b][k], score[a:b][k], unsure[a:b][k] = np.array(model["langs"], object)[best[k]], p[k], near[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
