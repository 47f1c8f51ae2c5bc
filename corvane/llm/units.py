"""Whole texts to ids with the tokenizers library, which is given each distinct unit of text once.

A tokenizer cuts a text into pieces before it merges.  A unit is a run of such
pieces whose cut no neighbour can change, so a text's ids are those of its units
in a row.  Units are cut by classes of bytes, a chunk of texts at once, and
numbered by their distinct strings; only strings not seen lately are encoded.
"""

from __future__ import annotations

import os
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.common import Lists, flat, unit_cuts


@dataclass(frozen=True)
class Kind:
    """How a tokenizer cuts texts.

    plain: units of Latin letters, digits and signs only, which pieces cuts as the
    tokenizer would, so that its model alone is needed for them; other units go
    through the whole tokenizer.
    """

    plain: re.Pattern
    pieces: re.Pattern
    lower: bool


_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: For byte-level tokenizers, whose pieces hold the white space before a word.
WITH_SPACE = Kind(re.compile(f"[ \\n]?[!-~{_LETTERS}]+"), re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \\n0-9{_LETTERS}]+|\\n"), False)
#: For tokenizers that lower-case, take each digit for itself and drop white space.
BLACK = Kind(re.compile(f"[ \\n]?[!-~{_LETTERS}]+"), re.compile(f"{_SHORT}|[{_LETTERS}]+|[0-9]|[^ \\n0-9{_LETTERS}]+"), True)
#: Byte-level tokenizers show bytes by these characters, the first 33 that are not printable from 256 on, and so forth.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class UnitEncoder:
    def __init__(self, path: str, kind: Kind):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # units hold none; texts that do go to self.whole
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kind, self.model = kind, self.library.model
        self.units = Lists(self._new)

    def _new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, rest = [b""] * len(units), []
        plain, pieces, lower, tokenize = self.kind.plain.fullmatch, self.kind.pieces.findall, self.kind.lower, self.model.tokenize
        for k, u in enumerate(x.decode() for x in units):
            if plain(u):
                shown = [p.encode().decode("latin-1").translate(_SHOWN) for p in pieces(u.lower() if lower else u)]
                out[k] = array("I", [t.id for p in shown for t in tokenize(p)]).tobytes()
            else:
                rest.append(k)
        for a in range(0, len(rest), 5000):
            part = rest[a : a + 5000]
            for k, x in zip(part, self.library.encode_batch_fast([units[k].decode() for k in part], add_special_tokens=False)):
                out[k] = array("I", x.ids).tobytes()
        return np.frombuffer(b"".join(out), "<i4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by end_id, and where each text's begin (and the end).

        Null counts as empty.  A text that holds an added token's string goes to the
        library whole, which gives that token's one id.
        """
        data, at = flat(texts)
        raw, marked = data.tobytes(), {}
        if any(a.encode() in raw for a in self.added):
            holds = [pc.fill_null(pc.match_substring(texts, a), False).to_numpy(zero_copy_only=False) for a in self.added]
            for k in np.flatnonzero(np.any(holds, axis=0)).tolist():
                marked[k] = self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids
            keep = np.ones(len(texts), bool)
            keep[[*marked]] = False
            data = data[np.repeat(keep, np.diff(at))]
            at = np.append(0, np.cumsum(np.diff(at) * keep))
        cuts = unit_cuts(data, at)
        ids, size = self.units(data, cuts)
        upto = np.append(0, np.cumsum(size))[np.searchsorted(cuts, at)]
        if marked:
            ids = np.insert(ids, np.repeat([upto[k] for k in marked], [len(x) for x in marked.values()]), [i for x in marked.values() for i in x])
            more = np.zeros(len(upto), np.int64)
            more[[k + 1 for k in marked]] = [len(x) for x in marked.values()]
            upto = upto + np.cumsum(more)
        if end_id is not None:
            ids = np.insert(ids, upto[1:], end_id)
            upto = upto + np.arange(len(upto))
        return ids.astype("<i4", copy=False), upto


@lru_cache(4)
def unit_encoder(path: str, kind: Kind) -> UnitEncoder:
    """One for each worker and file."""
    return UnitEncoder(path, kind)
