"""Vectorised byte kernels shared by the text operators.

An Arrow string column is one buffer of UTF-8 bytes and an array of offsets.  These helpers find
words and hash them for a whole batch in a few numpy passes, so that no Python code runs per word.
Callers walk a batch in chunks of bounded bytes (``chunks``), which bounds the temporary arrays; a
single longer text is a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words are separated by the six ASCII white-space bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at a time.
CHUNK = 1 << 19

_rng = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte; A-Z share those of a-z.
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=U)
BYTE_VALUE_EXACT = BYTE_VALUE.copy()
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = 0xD6E8FEB86659FD93 | 1


class _Powers:
    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            seq = np.full(max(n, 1 << 16), self.base, U)
            seq[0] = 1
            self.values = np.cumprod(seq)
        return self.values


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    base, end = int(offs[0]), int(offs[-1])
    buf = np.frombuffer(data, np.uint8, end)[base:] if data is not None and end > base else np.zeros(0, np.uint8)
    return buf, offs - base


def chunks(offs: np.ndarray, size: int = CHUNK):
    """Row ranges (a, b) of at most ``size`` bytes, or of one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def char_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return lead[offs[1:]] - lead[offs[:-1]]


def spans_of(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a byte mask; runs end at the end of a text."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = offs[(offs > 0) & (offs < n)]
    before[cuts] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever it stands."""
    n = len(buf)
    prefix = np.empty(n + 1, U)
    prefix[0] = 0
    np.cumsum(values[buf] * _UP.upto(n)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _DOWN.upto(n + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(_STEP))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each text the number of the first of its words (one entry more than texts)."""
    starts, ends = spans_of(~IS_SPACE[buf], offs)
    return starts, ends, np.searchsorted(starts, offs)


def run_hash(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` tokens; entry i is of tokens i to i+width-1."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for k in range(width):
        h = h * U(_BASE) + tokens[k : k + n]
    return mix(h + U(width * _STEP % 2**64))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles (lower-cased A-Z).

    A text of fewer words than ``width`` has its whole word sequence as the only one; a text without
    words has none.
    """
    starts, ends, first = words(buf, offs)
    h = span_hash(buf, starts, ends)
    runs = run_hash(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(run_hash(h[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out
