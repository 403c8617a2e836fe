"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text are replaced by typed placeholders, so that a question with other
values canonicalises to the same template.  Windows of ``WINDOW`` canonical tokens of the benchmark
are hashed; each document's windows are looked up by hash, hits on one diagonal (document position
less item position) are joined to runs, and each run is confirmed on the tokens themselves: literal
tokens must be equal, and the slots must be consistent: one value of the item always corresponds to
one value of the document (two values of the item may fall together).  A run with a conflict is
split: of its longest consistent parts, those with the fewest disputed changes come first, the others
give way where they overlap, and each part that still holds a window is confirmed.

A benchmark of at most ``BLOCK_WINDOWS`` windows (its size is counted first) goes to the executors whole, and the
documents are not shuffled at all.  A larger one stays in Spark: the windows of both sides are joined by
their hashes, and each pair of a document and an item that share one is confirmed by itself, so neither the driver nor
a broadcast holds what grows, and the documents are read a bounded number of times.

Tokens are words without the ASCII punctuation at their ends, lower-cased (A-Z).  A number is a token
of digits and ``.,:/-`` that begins with a digit; a unit is one of ``UNITS``; a name is a capitalised
token that does not begin a sentence or line.  As text is re-wrapped and quoted, windows are also hashed with
every capitalised token as a name; what begins a sentence on both sides is still compared as it is.
A window with fewer than ``LITERALS`` literal tokens is no evidence for a template and is used as it
stands only: the tokens themselves are hashed too, so verbatim windows are found whatever they are
made of.  An item shorter than a window is one window, if it has at least ``LITERALS`` tokens.

Defined results: null and empty texts match nothing; null or too short items match nothing; repeated
items and rows are each reported; other columns are ignored by the report and kept by the filter; empty
tables give no matches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K
from lodestrata.llm.store import written

WINDOW, LITERALS, BLOCK_WINDOWS = 8, 5, 1 << 20
# fixed values: words that are units of measure
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds lb lbs "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent % dollar dollars cent cents euro euros degree degrees km/h mph volt volts watt watts kb mb gb"
).split()

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$"]] = True
_SKIP = _PUNCT | K.IS_SPACE
_NUMERIC = np.zeros(256, bool)
_NUMERIC[[ord(c) for c in "0123456789.,:/-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACEHOLDER = K.mix(np.arange(1, 5, dtype=K.U) * K.U(0xA0761D6478BD642F))
_UNIT_BYTES = " ".join(UNITS).encode()


def _unit_hashes() -> np.ndarray:
    buf = np.frombuffer(_UNIT_BYTES, np.uint8)
    starts, ends, _ = K.words(buf, np.array([0, len(buf)]))
    return np.unique(K.span_hash(buf, starts, ends))


_UNIT_HASH = _unit_hashes()


def canonical(buf: np.ndarray, offs: np.ndarray) -> dict:
    """Tokens of a chunk: starts, ends, kind, kind with every capitalised token as a name, hash of the
    token itself, and the number of the first token of each text."""
    starts, ends, _ = K.words(buf, offs)
    n = len(buf)
    where = np.arange(n, dtype=np.int64)
    after = np.minimum.accumulate(np.where(_SKIP[buf], n, where)[::-1])[::-1] if n else where
    before = np.maximum.accumulate(np.where(_SKIP[buf], -1, where)) if n else where
    s, e = (after[starts], before[ends - 1] + 1) if len(starts) else (starts, ends)
    # a sentence begins at the first word of a text or line, and after . ! ? or : at the end of a word
    opens = np.ones(len(starts), bool)
    if len(starts) > 1:
        line = np.concatenate(([0], np.cumsum(buf == 10)))
        stop = np.isin(buf[ends[:-1] - 1], np.frombuffer(b".!?:", np.uint8))
        opens[1:] = stop | (line[starts[1:]] > line[ends[:-1]])
        firsts = np.searchsorted(starts, offs[:-1])
        opens[firsts[firsts < len(starts)]] = True
    real = s < e
    s, e, opens = s[real], e[real], opens[real]
    own = K.span_hash(buf, s, e)
    kind = np.zeros(len(s), np.uint8)
    if len(s):
        numeric = np.concatenate(([0], np.cumsum(_NUMERIC[buf])))
        kind[(numeric[e] - numeric[s] == e - s) & _DIGIT[buf[s]]] = NUMBER
        head, next_ = buf[s], buf[np.minimum(s + 1, e - 1)]
        capital = (head >= 65) & (head <= 90) & (next_ >= 97) & (e - s > 1)
        kind[capital & ~opens] = NAME
        kind[np.isin(own, _UNIT_HASH)] = UNIT
    named = np.where(capital & (kind == LITERAL), NAME, kind).astype(np.uint8) if len(s) else kind
    return {"s": s, "e": e, "kind": kind, "named": named, "own": own, "first": np.searchsorted(s, offs)}


def windows(tokens: dict, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows that lie within one text: of the tokens themselves, and, where
    they differ and have enough literals, of the two canonical forms."""
    exact = K.run_hash(tokens["own"], width)
    if not len(exact):
        return np.zeros(0, np.int64), exact
    text = np.searchsorted(tokens["first"], np.arange(len(tokens["s"])), "right")
    within = text[width - 1 :] == text[: len(exact)]
    at, hashes, last = [np.flatnonzero(within)], [exact[within]], exact
    for kind in (tokens["kind"], tokens["named"]):
        h = K.run_hash(np.where(kind == LITERAL, tokens["own"], _PLACEHOLDER[kind]), width)
        literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
        fits = within & (literal[width:] - literal[:-width] >= LITERALS) & (h != exact) & (h != last)
        at.append(np.flatnonzero(fits))
        hashes.append(h[fits])
        last = h
    return np.concatenate(at), np.concatenate(hashes)


class Block:
    """Some benchmark items with their windows."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        self.buf, offs = K.utf8(column)
        self.tokens = canonical(self.buf, offs)
        first = self.tokens["first"]
        at, h = windows(self.tokens)
        width = np.full(len(at), WINDOW)
        for k in np.flatnonzero(np.diff(first) < WINDOW):  # a short item is one window
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= LITERALS:
                one = {c: self.tokens[c][a:b] for c in ("s", "kind", "named", "own")} | {"first": np.array([0, b - a])}
                short, hashes = windows(one, b - a)
                at, h, width = np.append(at, short + a), np.append(h, hashes), np.append(width, np.full(len(short), b - a))
        order = np.argsort(h, kind="stable")
        self.at, self.hash, self.width = at[order], h[order], width[order]
        self.item = np.searchsorted(first, self.at, "right") - 1
        self.widths = sorted(set(width.tolist()))
        self.shift = K.U(44 if len(items) > 1 else 54)
        self.seen = np.zeros(1 << 64 - int(self.shift), bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True
        self.values = self._values(self.tokens, self.buf)

    @staticmethod
    def _values(tokens: dict, buf: np.ndarray):
        data = buf.tobytes()
        return lambda k: data[tokens["s"][k] : tokens["e"][k]].lower()

    def matches(self, buf: np.ndarray, offs: np.ndarray):
        """Confirmed runs: (text, item number, first token and end token in the text, first in the item,
        slots, slots with other values, byte start, byte end)."""
        tokens = canonical(buf, offs)
        hits = []
        for width in self.widths:
            at, h = windows(tokens, width)
            maybe = self.seen[(h >> self.shift).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = hi - lo
            pos = np.repeat(at, n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            right = self.width[entry] == width
            hits.append(np.column_stack([pos[right], entry[right]]))
        hits = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
        if not len(hits):
            return
        text = np.searchsorted(tokens["first"], hits[:, 0], "right") - 1
        item, at = self.item[hits[:, 1]], self.at[hits[:, 1]]
        width = self.width[hits[:, 1]]
        diagonal = hits[:, 0] - at
        order = np.lexsort((hits[:, 0], diagonal, item, text))
        value = self._values(tokens, buf)
        run = None
        for k in order.tolist():
            key, a, b = (int(text[k]), int(item[k]), int(diagonal[k])), int(hits[k, 0]), int(hits[k, 0] + width[k])
            if run and run[0] == key and a <= run[2]:
                run[2] = max(run[2], b)
                run[3].append((a, b))
            else:
                if run:
                    yield from self._confirmed(run, tokens, value)
                run = [key, a, b, [(a, b)]]
        yield from self._confirmed(run, tokens, value)

    def _confirmed(self, run, tokens, value):
        (text, item, diagonal), a, b, hits = run
        parts, lo, seen, other, disputed = [], a, {}, {}, set()
        for k in range(a, b):
            x, y = value(k), self.values(k - diagonal)
            kind, kind_there = tokens["named"][k], self.tokens["named"][k - diagonal]
            slot = kind == kind_there != LITERAL and not tokens["kind"][k] == self.tokens["kind"][k - diagonal] == LITERAL
            if x != y:
                other[k] = y
            first = lo
            if x != y and not slot:
                first = k + 1  # a hash met by chance
            elif slot:
                # the last place of this item value's last value, and of its values before
                was, at, before = seen.get(y, (x, -1, -1))
                if was != x:
                    before = at
                    disputed.add(y)
                seen[y] = x, k, before
                first = max(lo, before + 1)
            if first > lo:
                parts.append((lo, k))
                lo = first
        parts.append((lo, b))
        if len(parts) > 1:
            parts = self._apart(parts, hits, [k for k, y in other.items() if y in disputed])
        for a, b in parts:
            slots = int((tokens["kind"][a:b] != LITERAL).sum()) + sum(a <= k < b and tokens["kind"][k] == LITERAL for k in other)
            yield text, item, a, b, a - diagonal, slots, sum(a <= k < b for k in other), int(tokens["s"][a]), int(tokens["e"][b - 1])

    @staticmethod
    def _apart(parts, hits, disputed):
        """Parts that do not overlap and hold a window: few disputed changes first, then long ones."""
        holds = lambda p: any(p[0] <= a and b <= p[1] for a, b in hits)
        taken: list[tuple[int, int]] = []
        for p in sorted(filter(holds, parts), key=lambda p: (sum(p[0] <= k < p[1] for k in disputed), p[0] - p[1], p[0])):
            free = [p]
            for a, b in taken:
                free = [q for lo, hi in free for q in ((lo, min(hi, a)), (max(lo, b), hi)) if q[0] < q[1]]
            taken += filter(holds, free)
        return sorted(taken)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select("item_id", "text")


def whole(benchmark: DataFrame) -> Block | None:
    """The benchmark as one block; None where it is too large for that."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > 4 * BLOCK_WINDOWS:
        return None
    return Block([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()])  # bounded: one block


def _schemas(docs: DataFrame, benchmark: DataFrame) -> tuple[str, list[str]]:
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_type}, item_id {item_type}, start long, end long, n_tokens long, coverage double, slots long, slots_changed long, verbatim boolean"
    return schema, [x.split()[0] for x in schema.split(", ")]


def _spans(block: Block, part: np.ndarray, at: np.ndarray):
    """Confirmed runs of some texts: (text, item number, start, end, n_tokens, coverage, slots, slots_changed, verbatim)."""
    sizes, lead = np.diff(block.tokens["first"]), None
    for t, i, p, q, _, slots, other, x, y in block.matches(part, at):
        if lead is None:
            lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        yield t, i, int(lead[x] - lead[at[t]]), int(lead[y] - lead[at[t]]), q - p, float((q - p) / sizes[i]), slots, other, other == 0


def _batch(rows: list, ids: pa.DataType, items: pa.DataType | None, names: list[str]) -> pa.RecordBatch:
    kinds = [ids, items, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)


def _window_hashes(rows: DataFrame, widths: list[int], short: bool) -> DataFrame:
    """(key, h): hashes of the windows of rows (key, text), once each; ``short``: of whole short items too."""

    def run(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(1))
            for k in range(batch.num_rows):
                part = buf[offs[k] : offs[k + 1]]
                at = np.array([0, len(part)])
                if short:
                    h = Block([(0, batch.column(1)[k].as_py())]).hash
                else:
                    tokens = canonical(part, at)
                    h = np.concatenate([windows(tokens, w)[1] for w in widths])
                h = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(0)[k].as_py(), np.int64)), pa.array(h)], ["key", "h"])

    return rows.select("key", "text").mapInArrow(run, "key long, h long")


def _by_join(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated_spans() by an equi-join of window hashes, with ``_text`` (the text's SHA-256); for any size of the benchmark."""
    schema, names = _schemas(docs, benchmark)
    items = written(_items(benchmark).withColumn("key", F.monotonically_increasing_id()), "items")
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    hashes = lambda rows, short: _window_hashes(rows, list(range(LITERALS, WINDOW + 1)), short)
    met = hashes(texts, False).join(hashes(items, True).withColumnRenamed("key", "item"), "h").select("key", "item").distinct()
    pairs = texts.join(met, "key").join(items.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text")), "item")

    def run(batches):
        made: dict = {}
        for batch in batches:
            buf, offs = K.utf8(batch.column(1))
            rows = []
            for k, (i, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if (i, t) not in made:
                    if len(made) >= 512:
                        made.clear()
                    made[i, t] = Block([(i, t)])
                rows += [(batch.column(0)[k].as_py(), i, *r[2:], hashlib.sha256(buf[offs[k] : offs[k + 1]].tobytes()).hexdigest()) for r in _spans(made[i, t], buf[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]]))]
            if rows:
                plain = _batch([r[:-1] for r in rows], batch.schema.field(0).type, batch.schema.field(2).type, names)
                yield pa.RecordBatch.from_arrays([*plain.columns, pa.array([r[-1] for r in rows], pa.string())], [*names, "_text"])

    return pairs.select("doc_id", "text", "item_id", "item_text").mapInArrow(run, f"{schema}, _text string")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each confirmed run of each document: doc_id, item_id, start and end (code points),
    n_tokens, coverage of the item's tokens, slots, slots_changed, verbatim."""
    schema, names = _schemas(docs, benchmark)
    block = whole(benchmark)
    if block is None:
        return _by_join(docs, benchmark).drop("_text")

    def run(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(1))
            ids = batch.column(0)
            for a, b in K.chunks(offs):
                rows = [(ids[a + r[0]].as_py(), block.ids[r[1]], *r[2:]) for r in _spans(block, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])]
                if rows:
                    yield _batch(rows, batch.schema.field(0).type, None, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, in which no run of a benchmark item is confirmed."""
    at, block = docs.columns.index("text"), whole(benchmark)
    if block is None:
        found = _by_join(docs, benchmark).select("_text").distinct()
        rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), F.sha2("text", 256).alias("_text"))
        return rows.join(found, "_text", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

    def run(batches):
        for batch in batches:
            buf, offs = K.utf8(batch.column(at))
            keep = np.ones(batch.num_rows, bool)
            for a, b in K.chunks(offs):
                for match in block.matches(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]):
                    keep[a + match[0]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
