"""License scans by conditional compression.

Blocks of a text (lines, and runs of lines between blank ones) that mention a license at all are
candidates.  Around each mention, every template that can have enough of its words there is confirmed by
its exact wording: the words of the stretch and the template are aligned, and the differences are counted
and reported.  A confirmed stretch is compressed by itself and with each template as raw zstandard
dictionary; the template must save enough of the compressed size, and is ranked by it among all.  A template's name says which license it stands for.

One pass without a shuffle; templates are a fixed, small list.

Defined results: null texts and texts without a candidate give no rows; a block that no template
explains gives none; of templates that overlap the one with more of its words there, then the one with fewer
differences, then the one that saves more, wins; what is left of a block before and after a match is scanned again;
repeated rows are each reported; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: usual wordings of license notices; what two licenses share is named for neither
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/notice": "Released under the MIT License.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD/opening": _BSD,
    "BSD-2-Clause/text": f"{_BSD} {_BSD_TWO}",
    "BSD-3-Clause/text": f"{_BSD} {_BSD_TWO} 3. {_BSD_THREE}",
    "BSD-3-Clause/condition": _BSD_THREE,
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-only/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "GPL-2.0-only/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-or-later/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense/text": "This is free and unencumbered software released into the public domain.",
}
#: What any candidate has, in the regular expressions of Java, Python and RE2 alike.
CUE = r"(?i)licen[sc]e|permission|copyright|redistribut|public domain"
#: Least part of the compressed size of its match a template must save; least part of the template's words that
#: the match must have, in order.
LEAST_GAIN, LEAST_WORDS = 0.2, 0.85

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_models: dict = {}


def candidates(text: str):
    """(start, end) of each line with a cue, and of each longer run of non-blank lines with one."""
    cue = re.compile(CUE)
    at, run, lines = 0, None, []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            run = at if run is None else run
            if cue.search(line):
                lines.append((at, at + len(line)))
        elif run is not None:
            if lines:
                yield from lines
                if (run, at - 1) not in lines:
                    yield run, at - 1
            run, lines = None, []
        at += len(line) + 1


def _compressors():
    if not _models:
        import zstandard

        for name, template in TEMPLATES.items():
            d = zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            _models[name] = zstandard.ZstdCompressor(level=3, dict_data=d), [w.lower() for w in _WORD.findall(template)]
        _models[""] = zstandard.ZstdCompressor(level=3), []
    return _models


def wording(have: list[str], words: list[str]) -> tuple[list[str], list[str], tuple[int, int]]:
    """Words that ``have`` lacks, words it has between the template's, and the range of the match."""
    same = [m for m in SequenceMatcher(None, have, words, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return words, [], (0, 0)
    # the match is the densest stretch: the longest common piece with what stands next to it in order
    core = max(range(len(same)), key=lambda k: same[k].size)
    lo = hi = core
    slack = max(3, len(words) // 10)
    while lo > 0 and same[lo].a - (same[lo - 1].a + same[lo - 1].size) <= slack:
        lo -= 1
    while hi + 1 < len(same) and same[hi + 1].a - (same[hi].a + same[hi].size) <= slack:
        hi += 1
    kept = same[lo : hi + 1]
    covered = {k for m in kept for k in range(m.b, m.b + m.size)}
    used = {k for m in kept for k in range(m.a, m.a + m.size)}
    a, b = kept[0].a, kept[-1].a + kept[-1].size
    return [w for k, w in enumerate(words) if k not in covered], [have[k] for k in range(a, b) if k not in used], (a, b)


def _saved(stretch: str) -> list[tuple[float, str]]:
    """Part of the compressed size that each template saves, and its name: the most first."""
    models, data = _compressors(), stretch.encode()
    alone = len(models[""][0].compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, name) for name, (c, _) in models.items() if name), key=lambda x: (-x[0], x[1]))


def _around(text: str, found: list, have: list[str], cues: list[int], lo: int, hi: int):
    """Matches within the words lo to hi of a block, the best one of each template around each cue."""
    known: dict[tuple[int, int], list] = {}
    for name, (_, words) in _compressors().items():
        n, want, last = len(words), Counter(words), None
        reach = n + max(1, n // 10)
        for cue in cues if name else []:
            a, b = max(lo, cue - reach), min(hi, cue + reach + 1)
            if (a, b) == last or (Counter(have[a:b]) & want).total() < LEAST_WORDS * n:
                continue
            last = a, b
            lacks, more, (x, y) = wording(have[a:b], words)
            if n - len(lacks) < LEAST_WORDS * n or len(more) > max(1, n // 10):
                continue
            x, y = a + x, a + y
            start, end = found[x].start(), found[y - 1].end()
            if (x, y) not in known:
                known[x, y] = _saved(text[start:end])
            ranked = known[x, y]
            rank, gain = next((k, gain) for k, (gain, of) in enumerate(ranked) if of == name)
            if gain < LEAST_GAIN:
                continue
            # more of the template's words first: a short notice is also part of a longer header
            key = (-(n - len(lacks)), len(lacks) + len(more), rank)
            yield {"key": key, "words": (x, y), "start": start, "end": end, "license": name.split("/")[0], "template": name, "rank": rank + 1, "saved": round(gain, 6), "lacks": " ".join(lacks), "adds": " ".join(more), "exact": not lacks and not more}


def _all_in(text: str, start: int, end: int):
    """Matches of a block, and those of what is left before, between and after them."""
    found = list(_WORD.finditer(text, start, end))
    have, ends = [m[0].lower() for m in found], [m.end() for m in found]
    at = sorted({bisect(ends, start + m.start()) for m in re.finditer(CUE, text[start:end])})
    left = [(0, len(found))]
    while left:
        lo, hi = left.pop()
        if cues := at[bisect_left(at, lo) : bisect_left(at, hi)]:
            matches = _apart(list(_around(text, found, have, cues, lo, hi)))
            yield from matches
            if matches:
                edges = [lo, *[w for r in matches for w in r["words"]], hi]
                left += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]


def _apart(matches: list[dict]) -> list[dict]:
    """Matches that do not overlap, those of most words first, in the order they stand."""
    kept: list[dict] = []
    for r in sorted(matches, key=lambda r: (r["key"], r["start"], r["end"])):
        at = bisect(kept, r["start"], key=lambda k: k["start"])
        if (not at or kept[at - 1]["end"] <= r["start"]) and (at == len(kept) or kept[at]["start"] >= r["end"]):
            kept.insert(at, r)
    return kept


def scan_text(text: str) -> list[dict]:
    """Confirmed licenses of a text, in the order they stand."""
    return _apart([found for start, end in candidates(text) for found in _all_in(text, start, end)])


def license_spans(docs: DataFrame) -> DataFrame:
    """doc_id, block number, start, end (code points), license, template, rank, saved, lacks, adds, exact."""
    names = ["start", "end", "license", "template", "rank", "saved", "lacks", "adds", "exact"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches):
        for batch in batches:
            rows = [(i, k, r) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, r in enumerate(scan_text(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], batch.schema.field(0).type), pa.array([x[1] for x in rows], pa.int32()), *[pa.array([x[2][n] for x in rows], kind) for n, kind in zip(names, kinds)]], ["doc_id", "block", *names]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", "text").where(F.col("text").rlike(CUE))
    return asked.mapInArrow(run, f"doc_id {kind}, block int, start long, end long, license string, template string, rank int, saved double, lacks string, adds string, exact boolean")
