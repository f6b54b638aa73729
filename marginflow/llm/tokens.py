"""Token ids of whole texts by a given tokenizer file."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Separators that Python and the tokenizer library treat differently.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Fixed value: how the tokenizer file splits a lower-cased text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = regex.compile(_SPLIT)
#: The steps before the merge model that the tables stand for.
_STEPS = {
    "truncation": None,
    "padding": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: A full stop or comma forms one piece with a sign before it, else a piece of its own.
_STOP_AFTER_SIGN = re.compile(r"(?:[^\w\s]|_)[.,]\s")
#: Below this code point no character combines with its neighbour.
_SIMPLE = "ɐ"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never joins words across it.

    A word's ids don't depend on its neighbours, so each word is encoded once and then looked
    up.  Words of plain letters go to the library's merge model piece by piece; words with
    rarer characters go through the whole library, and so do texts that may hold special
    tokens, and all texts if the file prepares them in any other way than the tables assume.
    The table is emptied when full, so memory stays bounded (about 100 MB).  Ids are
    little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most_words = most_words
        self.words = _Words(self._word)
        self.letters = byte_letters()
        self.by_words = self._as_assumed()

    def _as_assumed(self) -> bool:
        """Whether the file prepares texts as the tables assume and all its special tokens hold ``<|``."""
        file = json.loads(self.tokenizer.to_str())
        special = file.get("added_tokens") or []
        return (
            all(file.get(step) == value for step, value in _STEPS.items())
            and file["model"].get("type") == "BPE"
            and all("<|" in t["content"] and not t["normalized"] for t in special)
        )

    def encode_whole(self, text: str) -> bytes:
        """By the whole library, without tables."""
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece
        if not (piece.isascii() and piece.isprintable()):
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= _SIMPLE:
            return self.encode_whole(word)
        word = word.lower()
        if word.isalpha():
            return self._piece(word)
        return b"".join([self._piece(p) for p in _PIECE.findall(word)])

    def encode(self, text: str) -> bytes:
        if not self.by_words or "<|" in text or _ODD_SPACE.search(text):
            return self.encode_whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:  # fewer different words: one case, no full stop or comma at the end
            text = text.lower()
            if not _STOP_AFTER_SIGN.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        if len(self.words) > self.most_words:
            self.words.clear()
        words = self.words
        return b"".join([words[w] for w in text.split()])


class _Words(dict):
    """Ids of words; a word that is asked for first is encoded then."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode(word)
        return found


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    return WordEncoder(path)


def unsigned_crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
