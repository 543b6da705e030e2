"""Token ids by the tokenizers library, with a bounded cache per worker.

Byte-level BPE first cuts a text into runs of letters, digits, other signs and
white space, and merges only inside them. A text is split here at places where
such a cut always stands: after letters or digits before anything else, and after
other signs before white space or, unless an apostrophe may open a contraction,
before letters or digits. Each unit is encoded once by the library, its ids are
joined with those of its neighbours and kept in a cache of bounded size; a
full cache is emptied. Words, which follow a single space between other characters,
have a cache of their own in front of that.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_ID = 2
_CACHE_WORDS, _CACHE_UNITS = 900_000, 700_000
#: The same where a worker has little room besides.
SMALL = 250_000, 150_000
_UNIT_CHARS = 64
_S, _SIGN = r"[^\S\x1c-\x1f]", r"(?:[^\w\s']|[_\x1c-\x1f])"
_UNIT = re.compile(rf"{_S}*[^\W_]+|{_S}*{_SIGN}*'(?:{_SIGN}|')*[^\W_]*|{_S}*{_SIGN}+|{_S}+")
_ASCII_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Edge(Exception):
    """A word beside further white space: there the cut before a space does not stand."""


def _byte_letters() -> dict[int, str]:
    """The character for each byte in a byte-level vocabulary: itself if visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Words(dict):
    """Word -> ids of the word after a space; encoded when first looked up."""

    def __init__(self, encoder: _Encoder):
        super().__init__()
        self.encoder, self.letters = encoder, _byte_letters()

    def __missing__(self, w: str) -> bytes:
        if not w or w[0].isspace() or w[-1].isspace():
            raise _Edge
        core, units = w.rstrip(_ASCII_SIGNS), self.encoder.units
        if core.isalpha() and self.encoder.plain and len(w) <= _UNIT_CHARS:
            ids = units.get(core)
            if ids is None:
                # ASCII letters stand for themselves
                letters = self.letters[32] + (core if core.isascii() else core.encode().decode("latin-1").translate(self.letters))
                ids = units[core] = array("I", [t.id for t in self.encoder.model.tokenize(letters)]).tobytes()
            if len(core) < len(w):
                ids += self.encoder.text(w[len(core) :])
        else:
            ids = self.encoder.text(" " + w)
            if len(w) > _UNIT_CHARS:
                return ids
        if len(self) >= self.encoder.room[0]:
            self.clear()
        self[w] = ids
        return ids


class _Encoder:
    """A vocabulary with its caches: of words, and of units (letters alone stand for those after a space)."""

    def __init__(self, path: str, room: tuple[int, int]):
        self.room = room
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.plain = isinstance(self.model, models.BPE) and isinstance(self.tok.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tok.normalizer is None
        self.words, self.units = _Words(self), {}

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        """Ids of any text by its units."""
        out, units = [], self.units
        if len(units) >= self.room[1]:
            units.clear()
        for u in _UNIT.findall(text):
            key = "\0" + u  # apart from the bare words
            ids = units.get(key)
            if ids is None:
                ids = self.library(u)
                if len(u) <= _UNIT_CHARS:
                    units[key] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.special):
            return self.library(text)
        words = text.split(" ")
        try:
            if words[0][-1:].isspace():
                raise _Edge
            return self.text(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
        except _Edge:
            return self.text(text)


_encoders: dict[str, _Encoder] = {}


def encode(texts: list[str | None], path: str, end: int | None = END_ID, room: tuple[int, int] = (_CACHE_WORDS, _CACHE_UNITS)) -> list[np.ndarray]:
    """Ids of each whole text as unsigned 32-bit integers, then the end id; null is empty.

    As with the library's own defaults, the text of a special token has the id of that token.
    room: entries of the caches of words and units; the ids do not depend on it.
    """
    if path not in _encoders or _encoders[path].room != room:
        _encoders[path] = _Encoder(path, room)
    tail = b"" if end is None else int(end).to_bytes(4, "little")
    return [np.frombuffer(ids + tail, "<u4") for ids in map(_encoders[path].encode, (t or "" for t in texts))]


def forget() -> None:
    """Drop the encoders of this worker with their caches."""
    _encoders.clear()
