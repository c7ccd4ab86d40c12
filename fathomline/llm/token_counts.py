"""Edit-aware token counts: a tree of pre-token counts per document, of which an edit renews only what it touches.

A document is a B-tree: leaves hold up to LEAF pre-tokens (their lengths in characters and token counts), inner nodes
the sums of both over their subtrees. An edit (start, end, text) finds its place by the character sums, takes the
pre-tokens it touches and, as context, those before it whose end could depend on what follows (white space, and one
more), splits the new text there and goes on until a new boundary falls on an old one beyond the edit; from there the
old pre-tokens hold, as a pre-token depends on nothing before its start. Only these are counted again by the
tokenizers library (each distinct pre-token once in a worker), and sums are changed along the path to the root. Texts
that hold an added token's string are counted whole, before and after.

Null texts are empty. Rows that repeat a doc_id are documents each. Edits must lie within the text and are applied one
after the other, each to the text that the ones before left. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pretoken import PretokenCache, cache_of, load_json

LEAF, FAN = 64, 16
#: Characters that are split beyond an edit at a time.
AHEAD = 64


class Node:
    """A leaf has chars and tokens of each pre-token; an inner node has kids. n: sums (chars, tokens, pre-tokens)."""

    __slots__ = ("chars", "kids", "n", "tokens")

    def __init__(self, chars=None, tokens=None, kids=None):
        self.chars, self.tokens, self.kids = chars, tokens, kids
        self.renew()

    def renew(self) -> None:
        self.n = (sum(self.chars), sum(self.tokens), len(self.chars)) if self.kids is None else tuple(map(sum, zip(*(k.n for k in self.kids), strict=True)))


class CountTree:
    def __init__(self, text: str, cache: PretokenCache):
        self.cache, self.text, self.renewed = cache, text, 0
        self.whole = cache.whole(text)
        self.root = self.build(*self.counted(text)) if text and not self.whole else None

    def counted(self, text: str) -> tuple[list[int], list[int]]:
        words = self.cache.split(text)
        return list(map(len, words)), list(map(self.cache.lengths.__getitem__, words))

    @staticmethod
    def build(chars: list[int], tokens: list[int]) -> Node | None:
        level = [Node(chars[a : a + LEAF], tokens[a : a + LEAF]) for a in range(0, len(chars), LEAF)]
        while len(level) > 1:
            level = [Node(kids=level[a : a + FAN]) for a in range(0, len(level), FAN)]
        return level[0] if level else None

    @property
    def n_tokens(self) -> int:
        if self.whole:
            return len(self.cache.encode(self.text)) // self.cache.dtype().itemsize
        return self.root.n[1] if self.root else 0

    def boundary(self, at: int) -> tuple[int, int]:
        """(start, number) of the pre-token that holds the character before or at `at`: the last that starts at or before it."""
        node, start, number = self.root, 0, 0
        while node.kids is not None:
            for kid in node.kids:
                if at < start + kid.n[0] or kid is node.kids[-1]:
                    node = kid
                    break
                start, number = start + kid.n[0], number + kid.n[2]
        ends = list(accumulate(node.chars))
        k = min(bisect_right(ends, at - start), len(ends) - 1)
        return start + (ends[k - 1] if k else 0), number + k

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in place of text[start:end]."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("an edit must lie within the text")
        old, self.text = self.text, self.text[:start] + new + self.text[end:]
        whole = self.whole or self.cache.whole(new) or self.cache.whole(self.text[max(0, start - 32) : start + len(new) + 32])
        if whole or self.root is None or not self.text:
            self.whole = whole and self.cache.whole(self.text)
            self.root = self.build(*self.counted(self.text)) if self.text and not self.whole else None
            self.renewed += len(self.text)
            return
        at, first = self.boundary(max(0, start - 1))
        if at:
            at, first = self.boundary(at - 1)
        while at and old[at - 1].isspace():
            at, first = self.boundary(at - 1)
        shift = len(new) - (end - start)
        pieces: list[str] = []
        here, stop = at, start + len(new)
        reach, last = min(len(self.text), stop + AHEAD), None
        while last is None:
            pieces, here = [], at
            for word in self.cache.split(self.text[at:reach]):
                if here > stop and reach < len(self.text) and here + len(word) + 1 >= reach:
                    break  # the cut could have split this one
                pieces.append(word)
                here += len(word)
                if here > stop and here < len(self.text):
                    old_at, number = self.boundary(here - shift)
                    if old_at == here - shift and here + 1 < reach:
                        last = number
                        break
            if last is None:
                if reach == len(self.text):
                    pieces, here = self.cache.split(self.text[at:]), len(self.text)
                    last = self.root.n[2]
                else:
                    reach = min(len(self.text), at + 2 * (reach - at))
        self.renewed += here - at
        self.splice(first, last, list(map(len, pieces)), list(map(self.cache.lengths.__getitem__, pieces)))

    def splice(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """New pre-tokens in place of those numbered first to last (exclusive)."""

        def leaves(chars, tokens):
            n = max(1, -(-len(chars) // LEAF))
            step = -(-len(chars) // n)
            return [Node(chars[a : a + step], tokens[a : a + step]) for a in range(0, len(chars), step)] if chars else []

        def change(node: Node, first: int, last: int, put: bool) -> list[Node]:
            if node.kids is None:
                a, b = max(0, first), max(0, min(last, node.n[2]))
                mid = (chars, tokens) if put else ([], [])
                return leaves(node.chars[:a] + mid[0] + node.chars[b:], node.tokens[:a] + mid[1] + node.tokens[b:])
            out, done, kids = [], 0, node.kids
            for i, kid in enumerate(kids):
                size = kid.n[2]
                mine = put and (first < done + size or i == len(kids) - 1)
                if mine or (first < done + size and last > done):
                    out += change(kid, first - done, last - done, mine)
                    put = put and not mine
                else:
                    out.append(kid)
                done += size
            return [Node(kids=out[a : a + FAN]) for a in range(0, len(out), FAN)]

        level = change(self.root, first, last, True)
        while len(level) > 1:
            level = [Node(kids=level[a : a + FAN]) for a in range(0, len(level), FAN)]
        self.root = level[0] if level else None
        while self.root is not None and self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]


def count_after_edits(docs: DataFrame, tokenizer: str, edits: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_renewed): edits gives a text's edits, from its end to its start."""
    shared = docs.sparkSession.sparkContext.broadcast(load_json(tokenizer))  # a vocabulary: bounded

    def run(batches):
        cache = cache_of(shared.value)
        for batch in common.slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                tree = CountTree(text or "", cache)
                before, todo = tree.n_tokens, edits(text or "")
                for start, end, new in todo:
                    tree.edit(start, end, new)
                out.append((before, len(todo), tree.n_tokens, tree.renewed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_renewed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_renewed long")


_PERSONAL = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d -]{6,}\d").finditer


def mask_personal(text: str) -> list[tuple[int, int, str]]:
    """Edits that put [mail] and [number] in place of mail addresses and long numbers."""
    return [(m.start(), m.end(), "[mail]" if "@" in m.group() else "[number]") for m in _PERSONAL(text)][::-1]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_renewed of every document: token counts before and after personal data is masked."""
    from public_tokenizers import path

    return count_after_edits(common.table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), mask_personal)


QUERIES = {"op2_token_counts": op2_token_counts}
