"""License scan by conditional compression (operator 6).

Method.  Sentences with a license cue word, joined with near ones, are the
candidate blocks of a text.  Each block is compressed by zstandard alone and
once with every template as a raw dictionary; templates are ranked by the
reduction: the bytes saved relative to the template's own compressed size, so
that the rest of the block does not weigh.  Every template that saves anything
is then compared word by word: it is confirmed if its words stand in the
block in order, with at most ``MAX_DIFFS`` of them different, and none of the
different ones carries the license's name or version.  The differences are
reported.  Of confirmed templates of one license in a block the first in rank
is kept.

Defined results.  One row for each license confirmed in a block; texts without
one, null and empty texts give none.  Blocks of any length are scanned in
overlapping pieces, longer than any template, so nothing is cut off.  Ties in
rank go to the template that is named first.  Repeated rows give repeated
results; null ids pass through; empty tables give empty results.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIFFS = 0.1
LEVEL = 3
NEAR = 1                # sentences without a cue that may lie between two of a block
PIECE, OVERLAP = 900, 300  # words

# Usual wordings of license notices, and the words in each that
# must be the same.
TEMPLATES = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software.", "merge sublicense sell"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                "version.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
                "version.", "gnu general public 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
     "creative commons attribution-noncommercial 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     "creative commons attribution-sharealike 4.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors "
                     "may be used to endorse or promote products derived from this software without specific prior written permission.",
     "neither endorse promote"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.", "fee"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
)
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "creative commons", "public domain")

_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?![\s]|$))+[.!?]*|[.!?]+")
_TRIM = re.compile(r"^[^0-9a-z]+|[^0-9a-z]+$")
_SCANNER: list = []


def normal(word: str) -> str:
    return _TRIM.sub("", word.lower())


def blocks(text: str | None) -> list[tuple[int, int]]:
    """Start and end (code points) of the candidate blocks of a text."""
    if not text or not any(c in text.lower() for c in CUES):
        return []
    out, gap = [], NEAR + 1
    for m in _SENTENCE.finditer(text):
        if not m.group().strip():
            continue
        if any(c in m.group().lower() for c in CUES):
            if out and gap <= NEAR:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            gap = 0
        else:
            gap += 1
    return out


class Scanner:
    """Compressors with every template as raw dictionary."""

    def __init__(self, templates=TEMPLATES):
        import zstandard
        make = lambda **k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **k)
        self.alone = make()
        self.given = [make(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                      for _, t, _ in templates]
        self.own = [len(self.alone.compress(t.encode())) for _, t, _ in templates]
        self.names = [n for n, _, _ in templates]
        self.words = [[w for w in map(normal, t.split()) if w] for _, t, _ in templates]
        self.fixed = [set(f.split()) for _, _, f in templates]
        self.memo: dict[str, list] = {}

    def rank(self, block: str) -> list[tuple[float, int]]:
        """``(reduction, template)``, largest reduction first."""
        raw = block.encode()
        size = len(self.alone.compress(raw))
        found = [((size - len(c.compress(raw))) / self.own[i], i) for i, c in enumerate(self.given)]
        return sorted(((r, i) for r, i in found if r > 0), key=lambda x: (-x[0], x[1]))

    def differences(self, template: int, words: list[str]) -> tuple[float, list[str]] | None:
        """Share of the template's words that stand in the block in order, and
        the wording differences; None if it is not confirmed."""
        want = self.words[template]
        m = difflib.SequenceMatcher(None, want, words, autojunk=False)
        runs = [b for b in m.get_matching_blocks() if b.size]
        same = sum(b.size for b in runs)
        if not runs or same < (1 - MAX_DIFFS) * len(want):
            return None
        first, last = runs[0], runs[-1]
        lo, hi = max(0, first.b - first.a), min(len(words), last.b + last.size + len(want) - last.a - last.size)
        diffs = []
        for op, a, b, c, d in difflib.SequenceMatcher(None, want, words[lo:hi], autojunk=False).get_opcodes():
            if op != "equal":
                if self.fixed[template] & set(want[a:b]):
                    return None
                diffs.append(f"{' '.join(want[a:b]) or '-'} -> {' '.join(words[lo:hi][c:d]) or '-'}")
        extra = hi - lo - same
        if extra > max(2, MAX_DIFFS * len(want)):
            return None
        return same / len(want), diffs

    def scan(self, block: str) -> list[tuple]:
        """``(license, template, reduction, same, differences)`` of a block."""
        if block in self.memo:
            return self.memo[block]
        tokens = block.split()
        out: dict[str, tuple] = {}
        for at in range(0, max(1, len(tokens) - OVERLAP), PIECE - OVERLAP):
            piece = tokens[at:at + PIECE]
            words = [w for w in map(normal, piece) if w]
            for reduction, i in self.rank(" ".join(piece)):
                if self.names[i] in out and out[self.names[i]][2] >= reduction:
                    continue
                ok = self.differences(i, words)
                if ok:
                    out[self.names[i]] = (self.names[i], i, reduction, ok[0], ok[1])
        found = sorted(out.values(), key=lambda r: (-r[2], r[1]))
        if len(self.memo) > 20_000:
            self.memo.clear()
        if len(block) < 2000:
            self.memo[block] = found
        return found


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start, end, license, reduction, same_words, n_diffs, diffs)``."""
    schema = (f"`{key}` {dict(df.dtypes)[key]}, start long, end long, license string, reduction double, same_words double, "
              "n_diffs long, diffs string")

    def run(batches):
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scanner = _SCANNER[0]
        for batch in batches:
            rows, at = [], []
            for r, t in enumerate(batch.column(1)):
                t = t.as_py()
                for a, b in blocks(t):
                    for name, _, reduction, same, diffs in scanner.scan(t[a:b]):
                        rows.append((a, b, name, round(reduction, 6), round(same, 6), len(diffs), "; ".join(diffs)))
                        at.append(r)
            cols = list(zip(*rows)) if rows else [[] for _ in range(7)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, types))],
                names=[key, "start", "end", "license", "reduction", "same_words", "n_diffs", "diffs"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
