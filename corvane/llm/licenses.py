"""License scans by conditional compression.

The words around every word that licenses use, as many before and after as the
longest template has and 20 more, are a candidate block; blocks that overlap are
one, and lines do not end it.  A block is cut into overlapping parts.  Where a
template would lie if a sign in the part were one of its own, the words there are
compressed, in lower case and without what is between them, alone and with the
template as raw zstandard dictionary.  Those that save
enough of the template's bytes are ranked by the bytes saved, and the first are
confirmed by the words that differ; what saves less is not looked at.  What is left
beside the wording found is searched again until nothing more is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, ids_and_texts

#: Wordings by which works are licensed.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "MIT": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Fixed value: words of which every template has one.
SIGNS = re.compile("licen[cs]e|licensed|permission|redistribut", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Windows that are confirmed at once, those that save the most first; the share of a
#: template's bytes that must be saved (of 1,300 wordings between other words, up to a tenth
#: of their words changed, none saved under 0.38, and other words mostly less, up to 0.46); the share
#: of a template's words that may differ; parts and windows whose findings a worker keeps.
RANKED, MIN_SAVED, MAX_DIFFERENT, CACHE_BLOCKS = 4, 0.3, 0.1, 20_000


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def _allowed(template: list[str]) -> int:
    return int(MAX_DIFFERENT * len(template))


def _pieces(template: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    """The template cut into 2 * _allowed + 1 pieces, and where they start.

    A confirmed wording lacks at most _allowed words and has at most _allowed others
    in between, so that one piece at least is whole.
    """
    n = 2 * _allowed(template) + 1
    cuts = [len(template) * k // n for k in range(n + 1)]
    return [(x, tuple(template[x:y])) for x, y in zip(cuts, cuts[1:])]


@lru_cache(1)
def _prepared() -> tuple:
    """(name, words, compressor, pieces) of each template, a compressor without a dictionary, and the most words."""
    import zstandard as z

    level = z.ZstdCompressionParameters.from_level(19, write_content_size=False, write_dict_id=False, window_log=17)
    with_ = lambda t: z.ZstdCompressor(compression_params=level, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT))
    own = [(k, [w for w, _, _ in words(t)]) for k, t in TEMPLATES.items()]
    return [(k, w, with_(" ".join(w)), _pieces(w)) for k, w in own], z.ZstdCompressor(compression_params=level), max(len(w) for _, w in own)


def different(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Words that differ between the template and the part of the block it aligns with best, and that part."""
    runs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template), 0, 0
    found = []
    for k, first in enumerate(runs):
        same = 0
        for last in runs[k:]:
            same += last.size
            found.append((max(len(template), last.b + last.size - first.b) - same, -same, first.b, last.b + last.size))
    n, _, a, b = min(found)
    return n, a, b


def placed(template: list[str], pieces: list[tuple[int, tuple[str, ...]]], block: list[str]) -> Iterator[tuple[int, int, int]]:
    """(words different, start, end) of every place in the block where the template is confirmed."""
    most, sizes = _allowed(template), {len(p) for _, p in pieces}
    at: dict[tuple[str, ...], list[int]] = {p: [] for _, p in pieces}
    for size in sizes:
        for k in range(len(block) - size + 1):
            if (hit := at.get(tuple(block[k : k + size]))) is not None:
                hit.append(k)
    for place in sorted({k - x for x, p in pieces for k in at[p]}):
        low = max(0, place - most)
        n, a, b = different(template, block[low : max(0, place + len(template) + most)])
        if n <= most:
            yield n, low + a, low + b


@lru_cache(4 * CACHE_BLOCKS)
def alone(window: str) -> int:
    """Bytes of the compressed window."""
    return len(_prepared()[1].compress(window.encode()))


@lru_cache(4 * CACHE_BLOCKS)
def saved(template: int, window: str) -> int:
    """Bytes fewer with the template as dictionary."""
    return alone(window) - len(_prepared()[0][template][2].compress(window.encode()))


def ranked(text: list[str]) -> list[tuple[int, int, int, int]]:
    """(bytes saved, template, first word, end) of windows that save enough, the most first; of equal ones the first by template and place."""
    out = []
    signs = [k for k, w in enumerate(text) if SIGNS.search(w)]
    for k, (_, template, _, _) in enumerate(_prepared()[0]):
        room, windows = _allowed(template) + 1, set()
        for own in (j for j, w in enumerate(template) if SIGNS.search(w)):
            windows |= {(max(0, s - own - room), min(len(text), s - own + len(template) + room)) for s in signs if s - own + room >= 0}
        for a, b in sorted(windows):
            gain = saved(k, " ".join(text[a:b]))
            if gain >= MIN_SAVED * len(" ".join(template).encode()):
                out.append((gain, k, a, b))
    return sorted(out, key=lambda x: (-x[0], *x[1:]))


def best(block: str, before: int | None = None) -> tuple[str, int, int, int, int] | None:
    """(license, start, end, bytes saved, words different) of the block's wording, or None.

    Windows are confirmed by rank, so many at a time, until one has a place.  Of the
    places in the windows that overlap it, the one with the fewest words different wins,
    then the longer one, then the first by name and place.  before: wordings start before
    this place.
    """
    own, found = _prepared()[0], words(block)
    text = [w for w, _, _ in found]
    order = ranked(text)

    def sure(windows: list[tuple[int, int, int, int]]) -> list[tuple]:
        out = []
        for gain, k, a, b in windows:
            name, template, _, pieces = own[k]
            for n, x, y in placed(template, pieces, text[a:b]):
                if before is None or found[a + x][1] < before:
                    out.append((n / len(template), -len(template), name, found[a + x][1], found[a + y - 1][2], gain, n, a + x, a + y))
        return out

    for start in range(0, len(order), RANKED):
        if first := sure(order[start : start + RANKED]):
            x, y = min(first)[-2:]
            rivals = sure([w for w in order[start + RANKED :] if w[2] < y and w[3] > x])
            _, _, name, a, b, gain, n, _, _ = min(p for p in first + rivals if p[-2] < y and p[-1] > x)
            return name, a, b, gain, n
    return None


def blocks(text: str) -> list[list[tuple[int, int]]]:
    """Candidate blocks: the places of their words, so many before and after every sign."""
    if not SIGNS.search(text):
        return []
    around = _prepared()[2] + 20
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out: list[list[int]] = []
    for m in SIGNS.finditer(text):
        k = bisect_right(spans, (m.start(), len(text))) - 1
        low, high = max(0, k - around), min(len(spans), k + around + 1)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [spans[low:high] for low, high in out]


class _Finder:
    def __init__(self):
        self.cache: dict[tuple[str, int | None], tuple | None] = {}

    def best(self, part: str, before: int | None) -> tuple | None:
        if (part, before) not in self.cache:
            if len(self.cache) >= CACHE_BLOCKS:
                self.cache.clear()
            self.cache[part, before] = best(part, before=before)
        return self.cache[part, before]

    def __call__(self, text: str | None) -> tuple[int, list[dict]]:
        found: list[dict] = []
        candidates = blocks(text) if text else []
        size = _prepared()[2] + 20  # more than a confirmed wording has
        for spans in candidates:
            for first in range(0, max(1, len(spans) - size), 2 * size):
                part = spans[first : first + 3 * size]
                # a wording that starts in the last third may be cut off here; it is whole in the next part
                stop = spans[first + 2 * size][0] if first + 3 * size < len(spans) else None
                low, high = part[0][0], part[-1][1]
                known = sorted((x["start"], x["end"]) for x in found if x["end"] > low)
                edges = [low, *(e for span in known for e in span), high]
                gaps = [*zip(edges[::2], edges[1::2])]
                while gaps:
                    a, b = gaps.pop()
                    if a >= b or stop is not None and a >= stop:
                        continue
                    if x := self.best(text[a:b], None if stop is None else min(stop, b) - a):
                        found.append({"license": x[0], "start": a + x[1], "end": a + x[2], "saved": x[3], "different": x[4]})
                        gaps += [(a, a + x[1]), (a + x[2], b)]
        return len(candidates), sorted(found, key=lambda x: x["start"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_blocks, licenses array<struct<license, start, end, saved, different>> in code points, by start, not overlapping.

    One row for each row in, from its whole text, however long; null and empty texts have
    no block, and an empty table gives no rows.  Other columns are not read, so their names
    can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder()
        kind = pa.list_(pa.struct([("license", pa.string()), *((c, pa.int64()) for c in ("start", "end", "saved", "different"))]))
        for batch in batches:
            for part in chunks(batch):
                n, found = zip(*map(finder, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_blocks", "licenses"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_blocks long, licenses array<struct<license: string, start: long, end: long, saved: long, different: long>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_licenses, and license:start:end:different of each, comma-joined."""
    said = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["different"].cast("string")))
    return scan(docs).select("doc_id", "n_blocks", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(said, ",").alias("licenses"))
