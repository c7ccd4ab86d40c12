"""Byte-level BPE by pre-tokens: each distinct pre-token is encoded by the tokenizers library and remembered.

A byte-level BPE never merges across pre-tokens, so the ids of a text are those of its pre-tokens, one after the
other. Texts that hold an added token's string go to the library whole, as it takes these out first.

A space before anything but white space always begins a pre-token, so texts are cut there first, which is cheap, and
what lies between two cuts is remembered with all its ids; only what is new is split into pre-tokens. A Latin word, with
or without full stops and commas behind it, needs no pattern for that.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import regex

from .common import Memo

#: How a byte-level pre-tokenizer without own pattern splits texts (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[int, str]:
    """The character by which a byte-level BPE names each byte: itself if it can be printed, else those from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printed else next(others)) for b in range(256)}


BYTE_CHARS = _byte_chars()
#: Letters that are letters in every version of Unicode.
_latin = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+").fullmatch
_at_spaces = re.compile(r" (?=\S)").split


@functools.lru_cache(maxsize=1)
def cache_of(text: str) -> PretokenCache:
    """This worker's cache, which later tasks find as earlier ones left it."""
    return PretokenCache(text)


def load_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class PretokenCache:
    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without normalizer can be encoded by pre-tokens")
        self.library = Tokenizer.from_str(text)
        self.split = regex.compile(PATTERN).findall
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.model = self.library.model
        self.known = Memo(self.ids, 100_000, 100_000)
        self.spaced = Memo(self.after_space, 900_000)
        self.lengths = Memo(lambda word: len(self.ids(word)) // self.dtype().itemsize, 900_000)

    def ids(self, word: str) -> bytes:
        """The library's ids of one pre-token."""
        return self.named(word.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARS))

    def named(self, text: str) -> bytes:
        """The library's ids of one pre-token whose bytes are named by characters."""
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def after_space(self, chunk: str) -> bytes | None:
        """Ids of a space and the chunk; None where the two may not be cut from what is before."""
        word = chunk.rstrip(".,")
        if word.isalpha():
            if word.isascii():  # ASCII letters are named by themselves
                ids = self.named(BYTE_CHARS[32] + word)
            elif _latin(word):
                ids = self.ids(" " + word)
            else:
                return self.by_words(" " + chunk)
            return ids if word == chunk else ids + self.known[chunk[len(word) :]]
        return None if not chunk or chunk[0].isspace() else self.by_words(" " + chunk)

    def by_words(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def whole(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as bytes of dtype."""
        if self.whole(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        first, *chunks = text.split(" ")
        try:
            return self.by_words(first) + b"".join(map(self.spaced.__getitem__, chunks))
        except TypeError:  # white space after a space
            first, *chunks = _at_spaces(text)
            return self.by_words(first) + b"".join(map(self.spaced.__getitem__, chunks))
