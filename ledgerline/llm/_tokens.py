"""Whole texts to token ids by the tokenizers library, with what it said about a word kept for the next time.

The vocabulary's rules drop white space, so a text's ids are those of its words in turn.  Where this is known to hold (no special
token in the text, and only characters on which lower-casing, normalization and word classes are plain), each distinct word goes
through the library's model once per worker while the memory lasts; any other text goes through the whole library.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Words kept per worker; when there are more, all are dropped and looked up anew.
KEPT_WORDS = 450_000

_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ‘’“”–—…•]")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_LETTER = _byte_letters()


class _Known(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        found = []
        for part in (word,) if word.isalpha() else _PART.findall(word):
            if not part.isascii():
                part = "".join([_LETTER[b] for b in part.encode()])
            found += [t.id for t in self.model.tokenize(part)]
        value = self[word] = np.array(found, "<u4").tobytes()
        return value


class Encoder:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.known = _Known(self.whole.model)
        self.special = [str(t) if isinstance(t, str) else t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def trim(self) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def texts(column: pa.Array, step: int = 256):
    """(first row, texts) of small parts of a column; null as the empty text."""
    for lo in range(0, len(column), step):
        yield lo, [t or "" for t in column.slice(lo, step).to_pylist()]
