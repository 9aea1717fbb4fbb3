"""Exact token ids from a public tokenizer, with a bounded cache of words.

Both vocabularies used here cut a text at spaces before they merge anything, so the ids of a
text are the ids of its words in a row. Words repeat, so each worker keeps the ids of the words
it met and asks the tokenizer only for new ones. The cuts made are those no token can cross:

- ``drops``: white space is dropped by the tokenizer; the text is cut at every space and line feed;
- ``leads``: one space goes with the word behind it; the text is cut before a space or line feed
  that stands alone between two words. Texts with other white space, or with longer runs of it,
  are given to the tokenizer whole.

A new word of Latin letters with punctuation behind it needs no normalising, so its pieces go
straight to the tokenizer's merge model; anything else takes the full way through the tokenizer.
Special-token strings in a text are the tokenizer's special tokens, as its defaults have them
(``add_special_tokens=False`` only keeps it from adding any).
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Sequence

_OTHER_SPACE = re.compile(r"[^\S \n]|[ \n]{2}")
#: Latin letters whose composed form is fixed.
_COMPOSED = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII punctuation but the apostrophe, with which contractions begin.
_MARKS = string.punctuation.replace("'", "")
_RUNS = ("  ", "\n\n", " \n", "\n ")
_LONG = 200


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Kept(dict):
    """Text to ids; what is asked for the first time is encoded and, unless long, kept."""

    def __init__(self, encode):
        super().__init__({"": b""})
        self._encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self._encode(text)
        if len(text) < _LONG:
            self[text] = ids
        return ids


class WordEncoder:
    """Little-endian ``uint32`` ids of whole texts; ``limit`` bounds the words kept."""

    def __init__(self, path: str, spaces: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._drops = spaces == "drops"
        self._cut = {"drops": self._dropped, "leads": self._led}[spaces]
        self._shown = _byte_letters()
        self._limit = limit
        self._words, self._pieces = _Kept(self._encode), _Kept(self._merge)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; a missing text has none."""
        return [self._text(text or "") for text in texts]

    def _text(self, text: str) -> bytes:
        if len(self._words) > self._limit:
            self._words = _Kept(self._encode)
        if len(self._pieces) > self._limit // 2:
            self._pieces = _Kept(self._merge)
        return b"".join(map(self._words.__getitem__, self._cut(text)))

    def _encode(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        lead = core[:1] if core[:1] in (" ", "\n") else ""
        letters = core[len(lead) :]
        if not letters.isalpha() or not (letters.isascii() or _COMPOSED.fullmatch(letters)):
            return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        pieces = self._pieces
        marks = pieces[word[len(core) :]]
        if self._drops:
            return pieces[letters.lower()] + marks
        if lead == "\n":
            return pieces[lead] + pieces[letters] + marks
        return pieces[core] + marks

    def _merge(self, piece: str) -> bytes:
        """Ids of a piece that the tokenizer would not cut further."""
        if not piece.isalpha() or not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._shown)
        return array("I", [token.id for token in self._model.tokenize(piece)]).tobytes()

    @staticmethod
    def _dropped(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    @staticmethod
    def _led(text: str) -> list[str]:
        lines = text.split("\n")
        if not all(map(str.isprintable, lines)) or any(run in text for run in _RUNS):
            if _OTHER_SPACE.search(text):
                return [text]
        return text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, spaces: str) -> WordEncoder:
    """The worker's encoder for a vocabulary, kept between tasks."""
    key = (path, spaces)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, spaces)
    return _encoders[key]
