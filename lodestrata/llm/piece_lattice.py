"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding.

A text is normalised as the vocabulary asks (identity, spaces as word marks, one mark in front) and cut
where a run of word marks begins; no piece crosses such a place, so the lattice of the text is
the product of the lattices of these units.  For every distinct unit of a batch the forward weights
(sums over all segmentations that end at a character) are filtered once; every occurrence then
draws its pieces backward from the end.  A piece of rank r weighs (r + 1)^-ALPHA: the model file is a BPE
one and has ranks in place of probabilities, which makes this Zipf's law for pieces.

The draws come from a counter-based generator over (seed, row key, number of the draw in the row), so
a row's segmentation depends on nothing but its key and text: not on partitions, batches or retries.
Characters without a piece, and literal word marks, go by bytes; decoding gives back the very text.

Defined results: null gives a null encoding, the empty text no pieces; repeated rows have equal
encodings; a null key counts as 0 and is as good as any other; other columns are ignored; an empty table gives an
empty result.  Very long texts and units are encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.token_count import tokenizer_path

ALPHA, SEED = 1.0, 20250101
#: Characters of text handled at once; units longer than this many characters go one by one.
CHUNK_CHARS, LONG = 400_000, 48
#: A factor for each character: it is the same for all segmentations, and keeps sums in range.
_SCALE = 300.0
_MARK, _LITERAL_MARK = "▁", "\udc81"  # a lone surrogate never occurs in a text
_UNIT = re.compile("▁*[^▁]+|▁+")
_vocabularies: dict = {}


class Vocabulary:
    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(len(self.pieces))]
        self.byte_id = np.full(256, -1, np.int32)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
        self.id_byte = {int(i): b for b, i in enumerate(self.byte_id)}
        usable = [i for i in range(len(self.pieces)) if not special[i] and _MARK not in self.pieces[i].lstrip(_MARK)]
        by_length: dict[int, list] = {}
        for rank, i in enumerate(usable):
            by_length.setdefault(len(self.pieces[i]), []).append((self.pieces[i], i, (rank + 1.0) ** -alpha))
        self.tables = {}
        for length, rows in sorted(by_length.items()):
            code = np.array([[ord(c) for c in p] for p, _, _ in rows], np.uint64).reshape(len(rows), length)
            h = np.zeros(len(rows), K.U)
            for k in range(length):
                h = h * K.U(_BASE) + code[:, k]
            h = K.mix(h)
            self.tables[length] = h, np.array([i for _, i, _ in rows], np.int32), np.array([w for _, _, w in rows]) * _SCALE**length
        # direct tables: by the leading bits of the hash, and by its low bits for pieces that met another one there
        self.high, self.low = {}, {}
        for length, (h, _, _) in self.tables.items():
            high, low = np.zeros(1 << _BITS, np.int32), np.zeros(1 << _BITS, np.int32)
            high[(h >> K.U(64 - _BITS)).astype(np.int64)] = np.arange(len(h))
            lost = np.flatnonzero(high[(h >> K.U(64 - _BITS)).astype(np.int64)] != np.arange(len(h)))
            low[(h[lost] & K.U((1 << _BITS) - 1)).astype(np.int64)] = lost
            assert (low[(h[lost] & K.U((1 << _BITS) - 1)).astype(np.int64)] == lost).all()
            self.high[length], self.low[length] = high, low if len(lost) else None
        self.fallback = (len(usable) + 1.0) ** -alpha * _SCALE
        self.longest = max(self.tables)

    def matches(self, chars: np.ndarray, left: np.ndarray):
        """For each length: positions where a piece of that length begins, and the piece's place in its table.

        left: characters from each position to the end of its unit.
        """
        h = np.zeros(len(chars), K.U)
        out = {}
        for length in range(1, self.longest + 1):
            m = len(chars) - length + 1
            if m <= 0:
                break
            h = h[:m] * K.U(_BASE) + chars[length - 1 :]
            if length in self.tables:
                table = self.tables[length][0]
                at = np.flatnonzero(left[:m] >= length)
                if not len(at):
                    break
                mixed = K.mix(h[at])
                k = self.high[length][(mixed >> K.U(64 - _BITS)).view(np.int64)]
                hit = table[k] == mixed
                if self.low[length] is not None:
                    miss = np.flatnonzero(~hit)
                    other = self.low[length][(mixed[miss] & K.U((1 << _BITS) - 1)).view(np.int64)]
                    k[miss] = other
                    hit[miss] = table[other] == mixed[miss]
                out[length] = at[hit], k[hit]
        return out


_BASE, _BITS = 0x9E3779B97F4A7C15, 17


def vocabulary(model: str, alpha: float = ALPHA) -> Vocabulary:
    if (model, alpha) not in _vocabularies:
        _vocabularies[model, alpha] = Vocabulary(model, alpha)
    return _vocabularies[model, alpha]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(K.U)


class Lattices:
    """Forward-filtered lattices of distinct units: for every end position its edges with cumulative weights.

    Edge e of end position k (a global character number + 1) leads back ``length[e]`` characters by piece ``piece[e]``
    (-1: the character by bytes); ``level[e]`` is the cumulated share of the position's edges up to e.
    """

    def __init__(self, vocab: Vocabulary, units: list[str]):
        sizes = np.array([len(u) for u in units], np.int32)
        self.end = np.cumsum(sizes, dtype=np.int32)
        self.chars = chars = _code_points("".join(units))
        n = len(chars)
        here = np.arange(n, dtype=np.int32)
        left = np.repeat(self.end, sizes) - here
        into_unit = here - np.repeat(self.end - sizes, sizes)
        begin, piece, weight, length = [], [], [], []
        single = np.zeros(n, bool)
        for size, (at, k) in vocab.matches(chars, left).items():
            begin.append(at.astype(np.int32))
            piece.append(vocab.tables[size][1][k])
            weight.append(vocab.tables[size][2][k])
            length.append(np.full(len(at), size, np.int32))
            if size == 1:
                single[at] = True
        bare = np.flatnonzero(~single).astype(np.int32)
        begin.append(bare), piece.append(np.full(len(bare), -1, np.int32)), weight.append(np.full(len(bare), vocab.fallback)), length.append(np.ones(len(bare), np.int32))
        begin, piece, weight, length = map(np.concatenate, (begin, piece, weight, length))
        finish = begin + length
        order = np.argsort(finish, kind="stable")
        begin, piece, weight, length, finish = begin[order], piece[order], weight[order], length[order], finish[order]
        # forward: a[k] sums the segmentations of the unit up to global end k; all units advance together
        opening = into_unit[begin]
        depth = opening + length  # characters from the unit's begin to the edge's end
        opening = opening == 0
        long = np.repeat(sizes > LONG, sizes)[begin] if sizes.max() > LONG else np.zeros(len(begin), bool)
        a = np.zeros(n + 1)
        share = np.zeros(len(begin))
        depth = np.where(long, 0, depth).astype(np.uint8)  # at most LONG
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, LONG + 2))
        # a[k] of a unit's begin is 1; ends of units share numbers with the next begin, so begins are kept apart
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if p == q:
                continue
            e = by_depth[p:q]
            into = np.where(opening[e], 1.0, a[begin[e]]) * weight[e]
            share[e] = into
            f = finish[e]  # sorted, and all edges to an end have this depth
            at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            a[f[at]] = np.add.reduceat(into, at)
        if long.any():
            self._long(np.flatnonzero(long), begin, finish, here - into_unit, weight, share)
        # shares of an end position cumulate within it
        count = np.bincount(finish, minlength=n + 1)
        first = np.concatenate(([0], np.cumsum(count)))
        norm = np.ones(n + 1)
        norm[count > 0] = 1 / np.add.reduceat(share, first[:-1][count > 0])
        share *= norm[finish]
        run = np.cumsum(share)
        before = np.concatenate(([0], run))[first[:-1]]
        self.level, self.first, self.piece, self.length = run - before[finish], first, piece, length

    @staticmethod
    def _long(edges, begin, finish, start, weight, share):
        """Edges of long units, in order of their ends: the same sums, rescaled as they run."""
        a: dict[int, float] = {}
        unit, at, into = None, None, 0.0
        for e in edges.tolist():
            s, b, f = int(start[begin[e]]), int(begin[e]), int(finish[e])
            if s != unit:
                unit, a, at = s, {s: 1.0}, None
            if f != at and at is not None and a.get(at, 1.0) > 0:
                if not 1e-100 < a[at] < 1e100:  # rescale what later edges can reach
                    k = 1 / a[at]
                    a = {x: y * k for x, y in a.items() if x > at - 64}
            at = f
            into = a.get(b, 0.0) * float(weight[e])
            share[e] = into
            a[f] = a.get(f, 0.0) + into


def encode_batch(vocab: Vocabulary, keys: np.ndarray, texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and piece ids of sampled segmentations, one for each text."""
    counts, all_units = [], []
    for text in texts:
        units = _UNIT.findall(_MARK + text.replace(_MARK, _LITERAL_MARK).replace(" ", _MARK)) if text else []
        counts.append(len(units))
        all_units += units
    if not all_units:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    number = dict.fromkeys(all_units)
    number = dict(zip(number, range(len(number))))
    occurrence = np.fromiter(map(number.__getitem__, all_units), np.int64, len(all_units))
    lattice = Lattices(vocab, list(number))
    sizes = np.diff(lattice.end, prepend=0)
    row = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(len(row)) - first[row]
    stream = K.mix(K.mix(keys.astype(np.int64).view(K.U) ^ K.U(seed))[row] + place.astype(K.U) * K.U(0xD1342543DE82EF95))
    at = lattice.end[occurrence].astype(np.int64)
    begin = at - sizes[occurrence]
    alive = np.arange(len(row))
    draws, step = [], 0
    tokens = np.zeros(len(row), np.int64)
    while len(alive):
        u = (K.mix(stream[alive] + K.U(step)) >> K.U(11)).astype(np.float64) * 2.0**-53
        k = at[alive]
        e, last = lattice.first[k], lattice.first[k + 1] - 1
        short = np.flatnonzero((lattice.level[e] <= u) & (e < last))
        while len(short):  # a position has few edges
            e[short] += 1
            short = short[(lattice.level[e[short]] <= u[short]) & (e[short] < last[short])]
        draws.append((alive, e, step))
        tokens[alive] += 1
        at[alive] = k - lattice.length[e]
        alive = alive[at[alive] > begin[alive]]
        step += 1
    # pieces were drawn from the end: turn each unit's around
    base = np.concatenate(([0], np.cumsum(tokens)))
    edges = np.empty(base[-1], np.int64)
    for who, e, step in draws:
        edges[base[who] + tokens[who] - 1 - step] = e
    ids = lattice.piece[edges]
    per_row = np.bincount(row, tokens, len(texts)).astype(np.int64)
    bare = np.flatnonzero(ids < 0)
    if len(bare):  # characters by bytes
        ends = np.searchsorted(lattice.first, edges[bare], "right") - 1
        width = np.ones(len(ids), np.int64)
        codes = lattice.chars[ends - 1].astype(np.int64).tolist()
        spelled = [(_MARK if c == 0xDC81 else chr(c)).encode() for c in codes]
        width[bare] = [len(s) for s in spelled]
        out = np.repeat(ids, width)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        out[out < 0] = vocab.byte_id[data]
        owner = np.repeat(row, tokens)
        per_row = np.bincount(owner, width, len(texts)).astype(np.int64)
        ids = out
    return np.concatenate(([0], np.cumsum(per_row))), ids


def decode(vocab: Vocabulary, ids) -> str:
    """The text of a sequence of piece ids."""
    out: list[bytes] = []
    for i in ids:
        b = vocab.id_byte.get(i)
        out.append(bytes((b,)) if b is not None else vocab.pieces[i].replace(_MARK, " ").encode())
    text = b"".join(out).decode()
    return text[1:] if text else text


class _Speller:
    """Bytes of every piece as one table, to decode a batch in a few passes."""

    def __init__(self, vocab: Vocabulary):
        spelled = [bytes((vocab.id_byte[i],)) if i in vocab.id_byte else p.replace(_MARK, " ").encode() for i, p in enumerate(vocab.pieces)]
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - end + size, size)].tobytes()


def sampled_pieces(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces (ids), text_sha256 of the decoded text, lossless (it is the text) of every row."""
    model = model or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_pieces", "pieces", "text_sha256", "lossless"]

    def run(batches):
        vocab = vocabulary(model, alpha)
        speller = _Speller(vocab)
        for batch in batches:
            keys = np.array([x or 0 for x in batch.column(0).to_pylist()], np.int64)
            texts = batch.column(1).to_pylist()
            sizes = np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))
            for a, b in K.chunks(sizes, CHUNK_CHARS):
                part = [t or "" for t in texts[a:b]]
                offs, ids = encode_batch(vocab, keys[a:b], part, seed)
                shas, same = [], []
                for i, t in enumerate(part):
                    back = speller.spell(ids[offs[i] : offs[i + 1]])[1:]
                    shas.append(hashlib.sha256(back).hexdigest())
                    same.append(back == t.encode())
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                if any(t is None for t in texts[a:b]):
                    lists = pa.array([None if t is None else x for t, x in zip(texts[a:b], lists.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), lists, pa.array(shas, pa.string()), pa.array(same)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, pieces array<int>, text_sha256 string, lossless boolean")


def decoded(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, pieces); null pieces give null."""
    model = model or tokenizer_path()

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode(vocab, x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("pieces").cast("array<int>").alias("pieces")).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
