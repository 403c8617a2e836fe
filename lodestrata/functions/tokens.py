"""Identifier tokenizers, as column expressions and for query strings.

``ascii`` (dialect ts): camel-case borders are split, anything but ASCII letters and digits separates, tokens are
lower-cased and single characters dropped.  ``unicode`` (dialect rs): runs of letters, digits and ``_``; each run
gives its lower-cased whole, then its ``_`` parts, and then the camel, acronym and digit parts of these, with
repetitions kept and parts equal to the whole left out.  Lower-casing is ASCII only there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BORDER = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_tokens(c) -> Column:
    # a capital after a small letter, or after a capital and before a small letter, begins a token; only capitals are looked at, in one pass.
    # The runs are extracted, not split at what separates them: tasks of one JVM that split texts hold each other up
    split = F.regexp_replace(_text(c), "[A-Z](?:(?<=[a-z][A-Z])|(?<=[A-Z]{2})(?=[a-z]))", " $0")
    return F.transform(F.regexp_extract_all(split, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), F.lower)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def unicode_tokens(c) -> Column:
    runs = F.regexp_extract_all(_text(c), F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))

    def of(run):
        whole = ascii_lower(run)
        parts = F.filter(F.split(run, "_"), lambda p: p != "")
        snake = F.when(F.size(parts) > 1, F.transform(parts, ascii_lower)).otherwise(F.array().cast("array<string>"))
        camel = F.flatten(F.transform(parts, lambda p: F.filter(F.split(p, _BORDER), lambda x: x != "")))
        fine = F.filter(F.transform(camel, ascii_lower), lambda x: (x != whole) & ~F.array_contains(snake, x))
        return F.filter(F.concat(F.array(whole), F.filter(snake, lambda x: x != whole), fine), lambda x: F.regexp_replace(x, "_", "") != "")

    return F.flatten(F.transform(runs, of))


def query_tokens(query: str, dialect: str = "ts") -> list[str]:
    """Distinct tokens of a query string, in order."""
    if dialect == "ts":
        s = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", query))
        found = [t for t in re.sub("[^a-zA-Z0-9]", " ", s).lower().split() if len(t) > 1]
    else:
        lower = lambda x: x.translate(str.maketrans(_UPPER, _LOWER))
        found = []
        for run in re.findall(r"\w+", query):
            whole, parts = lower(run), [p for p in run.split("_") if p]
            snake = [lower(p) for p in parts] if len(parts) > 1 else []
            camel = [lower(x) for p in parts for x in re.split(_BORDER, p) if x]
            found += [x for x in [whole, *[s for s in snake if s != whole], *[c for c in camel if c != whole and c not in snake]] if x.strip("_")]
    return list(dict.fromkeys(found))
