"""A source text with comments and string bodies blanked, its line numbers, and its brace structure."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_STRING = r"""r?'''(?:\\.|[^\\])*?'''|r?\"\"\"(?:\\.|[^\\])*?\"\"\"|`(?:\\.|[^\\`])*`|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\""""
_BLANK = re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_STRING})", re.S)
_XML_BLANK = re.compile(r"(?P<comment><!--.*?(?:-->|\Z))(?P<string>(?!))?", re.S)
_TOKEN = re.compile(r"[{}()\[\];\n]")
#: A header that goes on after a line break: it ends with one of these, or the next line begins with one.
_OPEN_END = re.compile(r"(?:[=,:+*/&|?<.(-]|=>|->|\b(?:extends|implements|with|on|by|where))\s*\Z")
_OPEN_NEXT = re.compile(r"\s*(?:[{:.=?&|+,)]|(?:extends|implements|with|on|by|where)\b)")

#: Annotations alone belong to what follows.
_ONLY_MARKS = re.compile(r"\s*(?:@[\w.]+(?:\([^()]*\))?\s*)+\Z")


_IN_BRACKETS, _ASSIGNED, _ARROW_END = re.compile(r"\([^()]*\)"), re.compile(r"(?<![=!<>])=(?!=)|=>"), re.compile(r"=>\s*\Z")
_BRACE, _BREAK, _SOLID = re.compile(r"[{}]"), re.compile("\n"), re.compile(r"\S")


def _spaces(text: str) -> str:
    return "\n".join(" " * len(line) for line in text.split("\n"))


def blanked(text: str, markup: bool = False) -> str:
    """Comments and string bodies as spaces; quotes, line breaks and all positions stay."""

    def blank(m: re.Match) -> str:
        s = m[0]
        if m.lastgroup == "string":
            edge = 3 if s.lstrip("r")[:3] in ("'''", '"""') else 1
            lead = len(s) - len(s.lstrip("r")) + edge
            return s[:lead] + _spaces(s[lead : len(s) - edge]) + s[len(s) - edge :]
        return _spaces(s)

    return (_XML_BLANK if markup else _BLANK).sub(blank, text)


@dataclass
class Segment:
    """A declaration or statement: its header, and the block after it."""

    start: int
    header: str
    open: int | None
    close: int
    end: int


class Source:
    def __init__(self, text: str, by_line: bool = False):
        self.text, self.masked, self.by_line = text, blanked(text), by_line
        self.breaks = [m.start() for m in _BREAK.finditer(text)]
        self.total = len(self.breaks) + (0 if text.endswith("\n") else 1) if text else 0
        self.close: dict[int, int] = {}
        stack = []
        for m in _BRACE.finditer(self.masked):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        for at in stack:  # open at the end of the file
            self.close[at] = len(text)

    def line(self, at: int) -> int:
        return min(bisect_right(self.breaks, at - 1) + 1, max(1, self.total))

    def segments(self, a: int, b: int):
        """Declarations and statements of a region, without those inside their blocks."""
        start = at = a
        depth = 0
        while m := _TOKEN.search(self.masked, at, b):
            c, at = m[0], m.end()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif c == "{":
                close = self.close[m.start()]
                header = self.masked[start : m.start()]
                at = min(b, close + 1)
                if depth or self._is_value(header):
                    continue
                yield Segment(self._begin(start, m.start()), header.strip(), m.start(), close, close)
                start = at
            elif depth:
                continue
            elif c == ";" or c == "}" or c == "\n" and self.by_line and self._ends(start, m.start(), b):
                header = self.masked[start : m.start()]
                if header.strip():
                    yield Segment(self._begin(start, m.start()), header.strip(), None, m.start(), m.start())
                start = at
        if self.masked[start:b].strip():
            yield Segment(self._begin(start, b), self.masked[start:b].strip(), None, b, b)

    def _begin(self, a: int, b: int) -> int:
        m = _SOLID.search(self.masked, a, b)
        return m.start() if m else a

    @staticmethod
    def _is_value(header: str) -> bool:
        """Whether a brace after this opens a literal, or the body of a value."""
        if "=" not in header:
            return False
        flat = _IN_BRACKETS.sub("", header)
        return bool(_ASSIGNED.search(flat)) and not _ARROW_END.search(flat) or flat.rstrip().endswith("=")

    def _ends(self, a: int, b: int, stop: int) -> bool:
        header = self.masked[a:b]
        return bool(header.strip()) and not _ONLY_MARKS.match(header) and not _OPEN_END.search(header) and not _OPEN_NEXT.match(self.masked[b:stop])
