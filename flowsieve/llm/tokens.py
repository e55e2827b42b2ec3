"""Token ids by a public tokenizer, as bytes of little-endian unsigned 32-bit integers.

The tokenizer splits at white space, so the ids of a text are those of its words in turn. A worker
has each distinct word encoded by the library once and then takes it from a bounded cache, which
saves nine tenths of the library's work. ``tests/llm/test_repair.py`` holds the result against
whole texts.
"""

from __future__ import annotations

import json
import os
import string
import sys
import unicodedata
from array import array
from functools import lru_cache

END_OF_WORD = "</w>"
PUNCTUATION = string.punctuation.encode()


def _byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordEncoder(dict):
    """Word bytes to id bytes; a missing word is encoded on first use.

    Entries live in two generations of ``keep`` words: the older one is dropped when the younger is
    full, and words still in use move to the younger. Words of letters go straight to the library's
    BPE model; all others take its whole pipeline.
    """

    def __init__(self, path: str, keep: int = 300_000) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=END_OF_WORD)
        self.letters = dict(enumerate(_byte_letters()))
        self.keep = keep
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if len(self) > self.keep:
            self.older = dict(self)
            self.clear()
        data = (text or "").encode()
        if b"\xcc" not in data and b"\xcd" not in data:  # no mark that joins a capital
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self._model(word.decode()) if word.isalpha() and word.islower() else self._odd(word)
        self[word] = found
        return found

    def _odd(self, word: bytes) -> bytes:
        """Words that are more than lower-case ASCII letters."""
        stem = word.rstrip(PUNCTUATION)
        tail = word[len(stem) :]
        if tail and stem.isalpha() and stem.islower():
            return self[stem] + self[tail]
        text = stem.decode()
        low = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        if not text.isalpha() or not low.isalpha() or len(stem) > 500:
            return _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if tail:
            return self[stem] + self[tail]
        return self._model(low.encode().decode("latin-1").translate(self.letters))

    def _model(self, text: str) -> bytes:
        return _packed([token.id for token in self.model.tokenize(text)])


def _packed(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
