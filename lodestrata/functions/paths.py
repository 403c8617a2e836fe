"""Path, hash and glob functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions that count as source code.
CODE_EXTENSIONS = ("dart", "kt", "java", "xml", "gradle", "ts", "tsx", "js", "jsx")
_FNV_START, _FNV_STEP = 0xCBF29CE484222325, 0x100000001B3


def posix(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"[^.]\.([^.]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def dirname(c: Column) -> Column:
    return F.regexp_extract(c, "^(.*)/[^/]*$", 1)


def normalized(c: Column) -> Column:
    """Resolve . and .. parts; null where .. leaves the root."""
    parts = F.filter(F.split(posix(c), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    done = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.when(done.isNotNull(), F.array_join(done, "/"))


def glob_regex(glob: str) -> str:
    """An anchored regular expression for an exclusion glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?``
    within one name."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = glob[k]
            out, k = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r"\.+^${}()|[]" else c), k + 1
    return f"^{out}$"


def excluded(c: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | c.rlike(glob_regex(g))
    return found


def _hashed(data: bytes, h: int = _FNV_START) -> str:
    for b in data:
        h = ((h ^ b) * _FNV_STEP) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a64(data: bytes) -> str:
    return _hashed(data)


#: Texts from which on a byte of all of them is hashed at once.
_TOGETHER = 16


def fnv1a64_all(texts: list[bytes]) -> list[str]:
    """Hashes of texts: byte by byte for all texts at once, longest first; the longest few, which go on alone, one by one."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    data = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
    starts, h = np.cumsum(sizes) - sizes, np.full(len(texts), _FNV_START, np.uint64)
    together = int(sizes[_TOGETHER - 1]) if len(sizes) >= _TOGETHER else 0
    ends = np.searchsorted(-sizes, -np.arange(together), "left")  # how many texts are longer than each place
    with np.errstate(over="ignore"):
        for at, n in enumerate(ends.tolist()):
            h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint64(_FNV_STEP)
    out = [""] * len(texts)
    for place, k in enumerate(order):
        out[k] = _hashed(texts[k][together:], int(h[place]))
    return out


@F.pandas_udf(T.StringType())
def fnv1a64_udf(text: pd.Series) -> pd.Series:
    known = text.notna()
    out = pd.Series([None] * len(text), index=text.index, dtype=object)
    out[known] = fnv1a64_all([t.encode() for t in text[known]])
    return out


def content_hash(c: Column, dialect: str = "ts") -> Column:
    """md5 (ts) or FNV-1a 64 (rs) of a text."""
    return F.md5(c) if dialect == "ts" else fnv1a64_udf(c)
