"""Encoding whole texts with a public tokenizer file, remembering the ids of frequent words.

The tokenizer named here drops white space and never joins what ASCII white space separates, so a
text's ids are the ids of its white-space separated pieces in order. Each worker keeps the ids of up to
MEMO pieces; for others it asks the tokenizers library, for plain words its model alone.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from caseloom.llm.common import held

MEMO = 350_000
WORD_TOKENIZER = "word_bpe_49k.json"
#: Words that the tokenizer's normaliser and split pattern leave whole (lower-case letters of ASCII and Latin-1), and the marks after them.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-/:-@[-`{-~]*)")

assert sys.byteorder == "little" and array("I").itemsize == 4


def tokenizer_path(name: str) -> str:
    """name: a file of the public tokenizers, or any path of a tokenizer file that executors can open."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordEncoder(dict):
    """encode(texts as UTF-8) -> the ids of each as little-endian unsigned 32-bit bytes. As a dict: what it remembers."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.letters, self.marks = Tokenizer.from_file(tokenizer_path(name)), byte_letters(), {"": b""}
        self.model = self.tokenizer.model

    def _library(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        """A word before punctuation marks has the ids of the word, and then of the marks."""
        text = piece.decode()
        parts = PLAIN.fullmatch(text)
        if parts is None:
            ids = self._library(text)
        else:
            word, marks = parts.groups()
            tail = self.marks.get(marks)
            if tail is None:
                tail = self._library(marks)
                if len(self.marks) < MEMO:
                    self.marks[marks] = tail
            ids = self.get(piece[: len(piece) - len(marks)]) if marks else None
            if ids is None:
                written = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
                ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
                if marks and len(self) < MEMO:
                    self[word.encode()] = ids
            ids += tail
        if len(self) < MEMO and len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.__getitem__
        # The tokenizer lower-cases; done before, for A-Z, more pieces are the same. Special tokens are found before that, in any text that may have one.
        return [b"".join(map(get, (t if b"<|" in t else t.lower()).split())) for t in texts]


def encoder(name: str = WORD_TOKENIZER) -> WordEncoder:
    """This worker's encoder."""
    return held(("words", name), lambda: WordEncoder(name))
