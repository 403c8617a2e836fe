"""Alignment of the tokens of two tokenizers on the same bytes.

Both tokenizers encode a space and the text.  A token is the range of bytes that it stands for.  The tokens of the second
tokenizer (B) are a static interval index: their starts and ends, in order.  Each token of the first (A) stabs it with its first and last byte,
by bisection, and what lies between is the list of B tokens that it overlaps.  A gap between two A tokens whose lists share no B
token is spanned by none; such gaps are offsets where tokens of both end, and they cut the text into groups.  All A tokens of a group are linked
to all its B tokens.

``alignments`` gives each text's tokens and groups, ``link_counts`` how many texts hold each pair of ids linked, and ``link_support``
each text's links held against these counts.  Counting is partial in each task and then by id pair.  To bring the counts back to
the texts, the pairs that make up at least 1 / 2^16 of all (text, pair) rows - so at most 2^16 pairs, whatever the corpus - and the
highest count of each A id (no more than A's vocabulary) go to every task.  The other rows are shuffled by their pair, of which none
has more than that share.

Long texts are encoded in parts, cut at a single space between two characters that are no white space: the first tokenizer's pre-tokens
begin there, and the second puts its word mark in the space's place (both are checked when the tokenizers are loaded; else texts are
encoded whole).

Defined results: a text that is null or empty, or that one of the tokenizers does not give back byte for byte (the second may change
characters, as the word mark itself), has no tokens, groups or links; repeated rows are aligned each by itself and each counts as a text;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import dropped, written
from lodestrata.llm.token_count import encoder, tokenizer_path

#: Code points from which on a text is split, UTF-8 bytes of a batch, and tokens of a group beyond which its pairs are made of distinct ids.
PART_CHARS, BATCH_BYTES, LARGE = 64 << 10, 256 << 10, 64
#: A pair of at least this share of all rows is known to every task; and distinct pairs that a task counts before it sends them on.
COMMON, TASK_PAIRS = 1 << 16, 1 << 20
_loaded: dict = {}


class Tokenizers:
    """A byte-level BPE tokenizer (A) and a sentencepiece model (B) with the bytes of each id.

    Where the ids of A follow its merges in order, its vocabulary is one of ranks, and the faster encoder for these gives the same ids.
    """

    def __init__(self, a: str, b: str):
        self.path = a
        with open(a, encoding="utf-8") as f:
            shape = json.load(f)
        first = shape["pre_tokenizer"] or {}
        self.b, splits = encoder(b)
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", False) and not first.get("add_prefix_space", False) and shape["normalizer"] is None
        self.splits = splits and plain
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(printable))}
        decoded = lambda piece: bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
        vocab = shape["model"]["vocab"] | {x["content"]: x["id"] for x in shape["added_tokens"]}
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            a_bytes[i] = decoded(piece)
        byte = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        b_bytes = [byte(i) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.spelling = Spelling(a_bytes), Spelling(b_bytes)
        self.ranked = self._ranked(shape["model"], a_bytes) if plain else None

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    @staticmethod
    def _ranked(model: dict, a_bytes: list[bytes]):
        import public_tokenizers
        import tiktoken

        n = len(model["merges"]) + 256
        if sorted(a_bytes[:256]) != [bytes([b]) for b in range(256)] or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        if any(model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) != 256 + k for k, m in enumerate(model["merges"])):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(a_bytes[:n])}, special_tokens={})

    def parts(self, text: str) -> list[str]:
        if len(text) <= PART_CHARS or not self.splits:
            return [text]
        out, a = [], 0
        while len(text) - a > PART_CHARS:
            cut = a + PART_CHARS
            while 0 <= (cut := text.find(" ", cut, len(text) - 1)) and any(c.isspace() or c == "▁" for c in (text[cut - 1], text[cut + 1])):
                cut += 1
            if cut < 0:
                break
            out.append(text[a:cut])
            a = cut + 1
        return [*out, text[a:]]

    def _by_a(self, parts: list[str]) -> list[np.ndarray]:
        spaced = [" " + p for p in parts]
        if self.ranked and max(map(len, spaced)) <= 4 * PART_CHARS:  # its pattern matcher gives up on very long runs
            return [self.ranked.encode_to_numpy(x, disallowed_special=()) for x in spaced]
        return [np.array(x.ids, np.int32) for x in self.a.encode_batch(spaced, add_special_tokens=False)]

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A (of a space and the text) and by B."""
        owners, parts, sides = [], [], ([[] for _ in texts], [[] for _ in texts])

        def flush():
            for side, ids in zip(sides, (self._by_a(parts), self.b.encode(parts, out_type=int, num_threads=1))):
                for owner, x in zip(owners, ids):
                    side[owner].append(np.asarray(x, np.int32))
            owners.clear(), parts.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                owners.append(i), parts.append(part)
                size += len(part)
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
        if parts:
            flush()
        return tuple([x[0] if len(x) == 1 else np.concatenate(x or [np.zeros(0, np.int32)]) for x in side] for side in sides)


class Spelling:
    """The bytes of each id."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def gives(self, ids: np.ndarray, whole: np.ndarray) -> bool:
        sizes = self.sizes[ids]
        if sizes.sum() != len(whole):
            return False
        return np.array_equal(self.bytes[np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(whole))], whole)


def tokenizers(a: str, b: str) -> Tokenizers:
    if (a, b) not in _loaded:
        _loaded[a, b] = Tokenizers(a, b)
    return _loaded[a, b]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first B token that it overlaps, and the one after the last: two stabbing queries on the index of B."""
    a_starts, b_starts = np.concatenate(([0], a_ends[:-1])), np.concatenate(([0], b_ends[:-1]))
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens in each group, in order."""
    if not len(a_ends) or not len(b_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = overlaps(a_ends, b_ends)
    first = np.flatnonzero(np.concatenate(([True], low[1:] >= high[:-1])))  # gaps that no B token spans
    return np.diff(np.append(first, len(a_ends))), np.diff(np.append(low[first], len(b_ends)))


def pairs(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links): the linked ids of each text, once each, with the number of their links.

    The groups of several texts stand one after the other; ``owner`` has the text of each.  A pair is the A id shifted by 32 bits, plus the B id.
    """
    a0, b0 = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    a, b = a.astype(np.int64), b.astype(np.int64)
    plain = np.flatnonzero((a_sizes <= LARGE) & (b_sizes <= LARGE))
    na, nb = a_sizes[plain], b_sizes[plain]
    # each A token of a group as often as the group has B tokens, beside these
    of_a = np.repeat(plain, na)
    at_a = np.arange(len(of_a)) - np.repeat(np.cumsum(na) - na, na) + a0[of_a]
    times = b_sizes[of_a]
    at_b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(b0[of_a], times)
    texts, keys, links = [np.repeat(owner[of_a], times)], [np.repeat(a[at_a] << 32, times) | b[at_b]], [None]
    links[0] = np.ones(len(keys[0]), np.int64)
    for g in np.flatnonzero((a_sizes > LARGE) | (b_sizes > LARGE)).tolist():
        u, m = np.unique(a[a0[g] : a0[g] + a_sizes[g]], return_counts=True)
        v, n = np.unique(b[b0[g] : b0[g] + b_sizes[g]], return_counts=True)
        keys.append(((u << 32)[:, None] | v).ravel()), links.append((m[:, None] * n).ravel()), texts.append(np.full(len(u) * len(v), owner[g]))
    texts, keys, links = np.concatenate(texts), np.concatenate(keys), np.concatenate(links)
    order = np.lexsort((keys, texts))
    texts, keys, links = texts[order], keys[order], links[order]
    at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return texts[at], keys[at], np.add.reduceat(links, at) if len(at) else links


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def _bytes(lists: pa.ListArray) -> pa.Array:
    """The values of each list as bytes."""
    offsets = (lists.offsets.to_numpy() * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lists.values.to_numpy(), np.int32))])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column and, for each row and at the end, how many stand before it."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1 + column.offset)[column.offset :] // 4
    values = np.frombuffer(data, np.int32, int(at[-1])) if data is not None and at[-1] else np.zeros(0, np.int32)
    return values[int(at[0]) : int(at[-1])], (at - at[0]).astype(np.int64)


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """row (a number of its own), key, a_ids, b_ids, and a_sizes, b_sizes: how many A and B tokens each group has; no shuffle.

    The four are arrays of int or, packed, their bytes (32 bits each).
    """
    a, b = a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model")
    names = ["row", "key", "a_ids", "b_ids", "a_sizes", "b_sizes"]

    def run(batches):
        from pyspark import TaskContext

        t = tokenizers(a, b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            cuts, size = [0], 0
            for i, x in enumerate(texts):
                size += len(x)
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    cuts.append(i + 1)
                    size = 0
            for s, e in zip(cuts, cuts[1:]):
                ids, none = t.encoded(texts[s:e]), np.zeros(0, np.int32)
                for k, x in enumerate(texts[s:e]):
                    whole = np.frombuffer(b" " + x.encode(), np.uint8)
                    if not x or not all(spelling.gives(side[k], whole) for spelling, side in zip(t.spelling, ids)):
                        ids[0][k] = ids[1][k] = none
                lists = [_lists(side) for side in ids]
                ends = [np.cumsum(spelling.sizes[np.asarray(x.values)]) for spelling, x in zip(t.spelling, lists)]
                # texts begin at ends of both, so they are cut as one
                sizes = groups(*ends)
                first = np.searchsorted(np.cumsum(sizes[0]) - sizes[0], lists[0].offsets.to_numpy()).astype(np.int32)
                lists += [pa.ListArray.from_arrays(pa.array(first), pa.array(x, pa.int32())) for x in sizes]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + e - s)), batch.column(0).slice(s, e - s), *[_bytes(x) if packed else x for x in lists]], names)
                row += e - s

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"row long, key {kind}, " + ", ".join(f"{c} {'binary' if packed else 'array<int>'}" for c in names[2:]))


def _columns(batch, start: int = 0) -> list:
    """(numbers, offsets) of a_ids, b_ids, a_sizes, b_sizes, which stand in the columns from ``start`` on."""
    return [_values(batch.column(start + k)) for k in range(4)]


def _linked(columns: list):
    """(text, pair, links) of packed columns."""
    (a, _), (b, _), (a_sizes, at), (b_sizes, _) = columns
    return pairs(a, b, a_sizes.astype(np.int64), b_sizes.astype(np.int64), np.repeat(np.arange(len(at) - 1), np.diff(at)))


def _small(batches, rows: int = 128):
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n of packed alignments: in how many texts the ids of the pair (A id shifted by 32 bits, plus B id) are linked."""

    def run(batches):
        held, size = [], 0

        def sent(parts):
            key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return key, np.bincount(where, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)

        for batch in _small(batches):
            _, key, _ = _linked(_columns(batch))
            key, n = np.unique(key, return_counts=True)
            held.append((key, n))
            size += len(key)
            if size > TASK_PAIRS:
                held = [sent(held)]
                size = len(held[0][0])
                if size > TASK_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sent(held)], ["pair", "n"])

    parts = aligned.select("a_ids", "b_ids", "a_sizes", "b_sizes").mapInArrow(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def link_support(aligned: DataFrame, counts: DataFrame, told=None, told_kinds: tuple = ()) -> DataFrame:
    """row, key, n_best, count_sum: how many of a text's links have the highest count of their A id, and the sum of counts over its links.

    ``told`` makes further columns, (name, type) in ``told_kinds``, of the packed columns in the same pass.  Both arguments must be written tables, the alignments packed.
    """
    a_of = F.shiftright("pair", 32)
    tops = counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("top")).toPandas()  # at most A's vocabulary
    top = np.zeros(int(tops["a"].max()) + 1 if len(tops) else 1, np.int64)
    top[tops["a"].to_numpy(np.int64)] = tops["top"].to_numpy(np.int64)
    rows = int(counts.agg(F.sum("n")).first()[0] or 0)
    common = counts.where(F.col("n") * COMMON >= rows).toPandas().sort_values("pair")  # at most COMMON pairs
    pair, n = common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    extra = [name for name, _ in told_kinds]
    names = ["row", "key", *extra, "n_best", "count_sum", "rare"]
    rare_kind = pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())]))

    def run(batches):
        for batch in _small(batches):
            columns = _columns(batch, 2)
            text, key, links = _linked(columns)
            at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            known = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            count = n[at[known]]
            total = lambda x: np.bincount(text[known], x, batch.num_rows).astype(np.int64)
            exact = np.zeros(batch.num_rows, np.int64)
            np.add.at(exact, text[known], count * links[known])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text[~known], minlength=batch.num_rows)))).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(key[~known]), pa.array(links[~known])], ["pair", "links"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(told(columns) if told else ()), pa.array(total(links[known] * (count == top[key[known] >> 32]))), pa.array(exact), pa.ListArray.from_arrays(pa.array(offsets), rare).cast(rare_kind)], names)

    kind = aligned.schema["key"].dataType.simpleString()
    held = written(aligned.select("row", "key", "a_ids", "b_ids", "a_sizes", "b_sizes").mapInArrow(run, f"row long, key {kind}, {''.join(f'{c} {k}, ' for c, k in told_kinds)}n_best long, count_sum long, rare array<struct<pair: long, links: long>>"), "links-held")
    tops = counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("top"))
    # rare pairs have less than 1 / COMMON of all rows each, so no key of this join is large
    few = counts.where(F.col("n") * COMMON < rows).join(F.broadcast(tops), a_of == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    single = held.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.links")
    more = single.join(few, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("links")).alias("sum"), F.sum(F.col("best") * F.col("links")).alias("best"))
    out = held.join(more, "row", "left")
    return out.select("row", "key", *extra, (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum", F.lit(0))).alias("count_sum"))


def spelled(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, texts: np.ndarray) -> list[bytes]:
    """The groups of each text as decimal ids: a1,a2|b1;a3|b2,b3.  ``texts`` has the number of tokens in front of each text, and in all."""
    if not len(a):
        return [b""] * (len(texts) - 1)
    a0, b0 = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(b0 - b_sizes, a_sizes)] = a
    ids[np.arange(len(b)) + np.repeat(a0, b_sizes)] = b
    after[a0 + b0 - b_sizes - 1], after[a0 + b0 - 1] = ord("|"), ord(";")
    width = len(str(int(ids.max())))
    number = np.arange(int(ids.max()) + 1)
    digits = np.stack([np.where((number >= 10**k) | (k == 0), number // 10**k % 10 + ord("0"), 0) for k in reversed(range(width))], axis=1).astype(np.uint8)
    spelt = np.concatenate([digits[ids], after[:, None]], axis=1)
    shown = spelt != 0
    ends = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))[texts].tolist()
    whole = spelt[shown].tobytes()
    return [whole[s : max(s, e - 1)] for s, e in zip(ends, ends[1:])]


def alignment_report(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    aligned = written(alignments(docs, a, b, key, packed=True), "alignments")
    counts = written(link_counts(aligned), "link-counts")

    def described(columns):
        ids = [x.astype(np.int64) for x, _ in columns]
        spelt = [hashlib.sha256(x).hexdigest() if x else "" for x in spelled(*ids, columns[0][1] + columns[1][1])]
        at_a, at_b, at = columns[0][1], columns[1][1], columns[2][1]
        links = np.concatenate(([0], np.cumsum(ids[2] * ids[3])))
        return [*(pa.array(np.diff(x)) for x in (at_a, at_b, at, links[at])), pa.array(spelt, pa.string())]

    kinds = (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"))
    out = link_support(aligned, counts, described, kinds)
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
