"""Checks of ICU messages: a small parser, and cheap column checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRANCHING = ("plural", "select", "selectordinal")
_ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
RESULT = T.StructType([T.StructField("args", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(_ERROR))])


class _Reader:
    """Recursive descent over one message; ``args`` in order of appearance."""

    def __init__(self, text: str):
        self.s, self.i, self.args, self.errors = text, 0, [], []

    def fail(self, kind: str, message: str) -> None:
        self.errors.append((kind, message))

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def word(self, stops: str) -> str:
        m = re.compile(f"[^{stops}]*").match(self.s, self.i)
        self.i = m.end()
        return m[0].strip()

    def quoted(self) -> None:
        """At an apostrophe: a doubled one is itself, one before a brace opens literal text."""
        if self.s[self.i + 1 : self.i + 2] not in ("{", "}"):
            self.i += 2 if self.s.startswith("''", self.i) else 1
            return
        end = re.compile(r"'((?:[^']|'')*)('|\Z)").match(self.s, self.i)
        self.i = end.end()

    def text(self, inside: bool) -> None:
        while c := self.peek():
            if c == "'":
                self.quoted()
            elif c == "{":
                self.argument()
            elif c == "}":
                if inside:
                    return
                self.fail("syntax", f"unmatched }} at {self.i}")
                self.i += 1
            else:
                self.i += 1

    def argument(self) -> None:
        at, self.i = self.i, self.i + 1
        name = self.word(",}")
        if name:
            if name not in self.args:
                self.args.append(name)
        else:
            self.fail("syntax", f"empty placeholder at {at}")
        if self.peek() == ",":
            self.i += 1
            kind = self.word(",}")
            if self.peek() and kind in BRANCHING:
                return self.branches(kind, name, at)
            depth = 1
            while depth and self.peek():
                depth += {"{": 1, "}": -1}.get(self.peek(), 0)
                self.i += 1
            if depth:
                self.fail("syntax", f"unclosed {{ at {at}")
        elif self.peek():
            self.i += 1
        else:
            self.fail("syntax", f"unclosed {{ at {at}")

    def branches(self, kind: str, name: str, at: int) -> None:
        if self.peek() != ",":
            self.fail("syntax", f"{kind} of {name} has no branches")
            self.i += 1
            return
        self.i += 1
        other = closed = False
        while True:
            self.i = re.compile(r"\s*").match(self.s, self.i).end()
            if not self.peek():
                break
            if self.peek() == "}":
                self.i, closed = self.i + 1, True
                break
            selector = self.word("{}")
            if self.peek() != "{":
                self.fail("syntax", f"{{ expected after {selector!r} of {name}")
                if self.peek() == "}":
                    self.i, closed = self.i + 1, True
                break
            other |= selector == "other"
            self.i += 1
            self.text(True)
            if self.peek() != "}":
                self.fail("syntax", f"unclosed branch {selector!r} of {name}")
                break
            self.i += 1
        if not closed and not self.peek():
            self.fail("syntax", f"unclosed {{ of {name} at {at}")
        if not other:
            self.fail("other", f"{kind} of {name} has no branch 'other'")


def parse_message(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Arguments and errors (kind, message) of a message."""
    r = _Reader(text)
    r.text(False)
    return r.args, r.errors


@F.pandas_udf(RESULT)
def icu_parse(text: pd.Series) -> pd.DataFrame:
    rows = [parse_message(t) if t is not None else (None, None) for t in text]
    return pd.DataFrame({"args": [a for a, _ in rows], "errors": [None if e is None else [{"kind": k, "message": m} for k, m in e] for _, e in rows]})


def placeholders(c: Column) -> Column:
    """Sorted names in simple or typed placeholders, by pattern only."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\s*([A-Za-z_]\w*)\s*[,}]"), F.lit(1))))


def brace_balance(c: Column) -> Column:
    """Opening less closing braces."""
    return F.char_length(F.replace(c, F.lit("}"), F.lit(""))) - F.char_length(F.replace(c, F.lit("{"), F.lit("")))


def lacks_other(c: Column) -> Column:
    return c.rlike(r", ?(plural|select),") & ~c.rlike(r"other ?\{")


_CASE = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
BRANCHES = T.StructType([T.StructField("variable", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("cases", T.ArrayType(_CASE))])


def branches_of(text: str) -> tuple[str, str, dict[str, str]] | None:
    """Variable, kind and cases of a message that is one plural, select or gender as a whole; None for any other."""
    s = text.strip()
    head = re.match(r"\{(\w+)\s*,\s*(plural|select|gender)\s*,", s)
    if head is None:
        return None
    cases: dict[str, str] = {}
    begin, depth, name = head.end(), 0, ""
    for m in re.compile(r"[{}]").finditer(s, head.end()):
        if m[0] == "{":
            if depth == 0:
                name, begin = s[begin : m.start()].strip(), m.end()
            depth += 1
        elif depth == 0:
            break
        else:
            depth -= 1
            if depth == 0:
                if name:
                    cases[name] = s[begin : m.start()]
                begin = m.end()
    return head[1], head[2], cases


@F.pandas_udf(BRANCHES)
def icu_branches(text: pd.Series) -> pd.DataFrame:
    found = [None if t is None else branches_of(t) for t in text]
    return pd.DataFrame({
        "variable": [f and f[0] for f in found], "kind": [f and f[1] for f in found],
        "cases": [None if f is None else [{"name": k, "text": v} for k, v in f[2].items()] for f in found],
    })
