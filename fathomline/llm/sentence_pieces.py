"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces, scores and flags come from a model file. White space becomes the marker U+2581, one is put in front where the
model says so, and the best path by the sum of scores is found over the trie of pieces' UTF-8 bytes. A character that
no piece covers costs the least score less 10 and is written as its bytes' pieces. Among equal paths the one that
reaches a position first stays: shorter last pieces lose to longer ones that begin earlier.

No piece holds a marker after another character, so the best path splits before each run of markers, and likewise
around characters that occur in no piece of several characters (a line end). Each distinct part is encoded once in a
worker and remembered (those of up to LONG bytes); new parts of a batch advance together through the trie in numpy. Where a model's pieces do hold
such markers, texts are encoded whole.

A BPE model's scores are merge ranks; they become log probabilities by Zipf's law, -log(rank + 2.7) - log(log(pieces)),
and the result is the unigram path under these, not the merges'. Models with a normalisation table or with extra white space removed are
refused. Null texts are empty and have no ids. A literal U+2581 decodes to a space, as in the library.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Bytes of a part from which it is encoded alone.
LONG = 200
#: Bytes of parts, each as long as the longest, that are encoded at once; each takes some 30 bytes of memory meanwhile.
CELLS = 300_000
#: Scores are added up as whole multiples of 1 / SCALE, so that sums are exact and ties are ties.
SCALE = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protobuf message: int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """Pieces, scores, kinds and flags of a model file's bytes."""

    def __init__(self, model: bytes):
        self.piece, self.score, self.kind = [], [], []
        self.dummy_prefix, self.escape = True, True
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                self.piece.append(got.get(1, b""))
                self.score.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kind.append(got.get(3, NORMAL))
            elif number == 3:
                got = dict(_fields(value))
                self.dummy_prefix, self.escape = bool(got.get(3, 1)), bool(got.get(5, 1))
                if got.get(2) or got.get(4, 1) or not self.escape:
                    raise ValueError("the model normalises texts in a way that is not supported")
        if any(n == 2 and dict(_fields(v)).get(3, 1) == 2 for n, v in _fields(model)):
            n = len(self.piece)
            self.score = [-math.log(min(max(-s, 0.0), n) + 2.7) - math.log(math.log(n)) for s in self.score]
        normal = [s for s, k in zip(self.score, self.kind, strict=True) if k == NORMAL]
        self.unknown_score = float(round((min(normal) - 10.0) * SCALE))
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)

    def entries(self) -> list[tuple[bytes, int]]:
        return [(p, i) for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k in (NORMAL, USER) and p]


class DoubleArray:
    """A trie in two arrays: from state s by byte b to base[s] + b + 1, if check there is s. value: a piece, or -1."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in entries:
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = value
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        free, wide, queue = 257, 257, [(0, 0)]  # wide: nodes of several children look on from here, so that no slot is tried again and again
        while queue:
            node, state = queue.pop()
            kids = children[node]
            value[state] = values[node]
            if not kids:
                continue
            codes = sorted(b + 1 for b in kids)
            while taken[free]:
                free += 1
            first = free if len(codes) == 1 else max(free, wide)
            while True:
                b = first - codes[0]
                if b >= 0 and not any(taken[b + c] for c in codes):
                    break
                first += 1
                if first + 512 >= size:
                    grow = size
                    base, check, value = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
                    taken.extend(bytes(grow))
                    size += grow
            base[state] = b
            if len(codes) > 1:
                wide = max(wide, first - 64)
            for c in codes:
                taken[b + c] = 1
                check[b + c] = state
                queue.append((kids[c - 1], b + c))
        self.base, self.check, self.value = (np.append(x, np.full(512, fill, np.int32)) for x, fill in ((base, 0), (check, -1), (value, -1)))
        self.longest = max((len(k) for k, _ in entries), default=1)


def marked(part: str) -> bytes:
    return part.replace(" ", MARK).encode("utf-8", "replace")


class Unigram:
    def __init__(self, model: bytes):
        self.pieces = p = Pieces(model)
        entries = p.entries()
        self.trie = DoubleArray(entries)
        top = max((s for s, k in zip(p.score, p.kind, strict=True) if k == NORMAL), default=0.0)
        self.score = np.rint(np.array([len(x.decode("utf-8", "replace")) * top - 0.1 if k == USER else s for x, s, k in zip(p.piece, p.score, p.kind, strict=True)]) * SCALE)
        texts = [e.decode("utf-8") for e, _ in entries]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", t) for t in texts)
        joined = {c for t in texts if len(t) > 1 for c in t}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.parts = re.compile(f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else "")).findall
        self.out = [bytes([int(x[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else x.replace(MARK.encode(), b" ") for x, k in zip(p.piece, p.kind, strict=True)]
        self.memo = common.Memo(lambda part: np.array(self.path(marked(part)), "<i4").tobytes())

    # --- encoding

    def spaced(self, text: str | None) -> str:
        """The normal text with spaces for markers: as keys, parts in ASCII take less memory than with a marker."""
        if not text:
            return ""
        return ((" " if self.pieces.dummy_prefix else "") + text).replace(MARK, " ")

    def normal(self, text: str | None) -> str:
        return self.spaced(text).replace(" ", MARK)

    def fallback(self, char: bytes) -> list[int]:
        return [self.pieces.byte[b] for b in char] if len(self.pieces.byte) == 256 else [self.pieces.unknown]

    def path(self, data: bytes) -> list[int]:
        """The best path through one marked part, a character at a time."""
        n, t, score = len(data), self.trie, self.score
        base, check, value = t.base, t.check, t.value
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue
            width = 1
            while i + width < n and data[i + width] & 0xC0 == 0x80:
                width += 1
            state, single = 0, False
            for k in range(i, min(n, i + t.longest)):
                to = base[state] + data[k] + 1
                if check[to] != state:
                    break
                state = to
                if value[to] >= 0:
                    single |= k + 1 == i + width
                    s = best[i] + score[value[to]]
                    if s > best[k + 1]:
                        best[k + 1], back[k + 1] = s, (i, int(value[to]))
            if not single and best[i] + self.pieces.unknown_score > best[i + width]:
                best[i + width], back[i + width] = best[i] + self.pieces.unknown_score, (i, -1)
        out, at = [], n
        while at:
            start, piece = back[at]
            out += [piece] if piece >= 0 else self.fallback(data[start:at])[::-1]
            at = start
        return out[::-1]

    def paths(self, parts: list[bytes]) -> list[bytes]:
        """Best paths of parts of at most LONG bytes, all at once; ids as little-endian int32."""
        n = len(parts)
        size = np.array([len(p) for p in parts], np.int64)
        width = int(size.max())
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width).astype(np.int32)
        inside = np.arange(width) < size[:, None]
        starts = ((text & 0xC0) != 0x80) & inside
        t = self.trie
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        ends = np.concatenate([starts[:, 1:] | ~inside[:, 1:], np.ones((n, 1), bool)], 1)  # a character ends with this byte
        for i in range(width):
            rows = np.flatnonzero(starts[:, i])
            if not len(rows):
                continue
            state = np.zeros(len(rows), np.int32)
            live, at = np.arange(len(rows)), rows
            single, first_end = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
            for k in range(i, width):
                to = t.base[state] + text[at, k] + 1
                ok = (t.check[to] == state) & inside[at, k]
                live, at, state = live[ok], at[ok], to[ok]
                if not len(live):
                    break
                got = t.value[state]
                hit = got >= 0
                if hit.any():
                    r, v = at[hit], got[hit]
                    s = best[r, i] + self.score[v]
                    better = s > best[r, k + 1]
                    r2 = r[better]
                    best[r2, k + 1], back[r2, k + 1], piece[r2, k + 1] = s[better], i, v[better]
                    one = live[hit & ends[at, k]]
                    single[one] |= first_end[one] == 0
                done = live[ends[at, k]]
                first_end[done] = np.where(first_end[done] == 0, k + 1, first_end[done])
            lone = np.flatnonzero(~single)
            if len(lone):
                r = rows[lone]
                stop = i + 1 + np.argmax(ends[r, i:], 1)
                s = best[r, i] + self.pieces.unknown_score
                better = s > best[r, stop]
                r, stop = r[better], stop[better]
                best[r, stop], back[r, stop], piece[r, stop] = s[better], i, -1
        ids = np.zeros((n, width), np.int32)
        count, at, odd = np.zeros(n, np.int64), size.copy(), np.zeros(n, bool)
        rows = np.arange(n)
        while len(rows):
            count[rows] += 1
            got = piece[rows, at[rows]]
            odd[rows[got < 0]] = True
            ids[rows, width - count[rows]] = got
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return [np.array(self.path(p), "<i4").tobytes() if odd[k] else ids[k, width - count[k] :].tobytes() for k, p in enumerate(parts)]

    def learn(self, parts: set[str]) -> None:
        memo = self.memo
        room = max(0, memo.core - len(memo))
        if len(memo.late) + len(parts) - room > memo.recent:
            memo.late.clear()
        coded = sorted(((p, marked(p)) for p in parts), key=lambda x: len(x[1]))
        at = 0
        while at < len(coded) and len(coded[at][1]) <= LONG:
            to = at
            while to < len(coded) and len(coded[to][1]) <= LONG and (to + 1 - at) * len(coded[to][1]) <= CELLS and len(coded[to][1]) <= 2 * len(coded[at][1]) + 4:
                to += 1
            for (p, _), got in zip(coded[at:to], self.paths([x for _, x in coded[at:to]]), strict=True):
                (memo if len(memo) < memo.core else memo.late)[p] = got
            at = to

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian int32."""
        texts = [self.spaced(t) for t in texts]
        if not self.splits:
            return [np.array(self.path(marked(t)), "<i4").tobytes() for t in texts]
        split = [self.parts(t) for t in texts]
        self.learn({p for parts in split for p in parts if p not in self.memo and p not in self.memo.late})
        return [b"".join(map(self.memo.__getitem__, parts)) for parts in split]

    # --- decoding

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.pieces.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def unigram_of(model: bytes) -> Unigram:
    """This worker's model, which later tasks find as earlier ones left it."""
    return Unigram(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """docs with pieces (array of ids), n_byte_pieces and, if check, round_trip (decoding gives the text back), in place of columns of these names."""
    docs = docs.drop("pieces", "n_byte_pieces", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # a vocabulary: bounded
    fields = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_byte_pieces", T.LongType())] + [T.StructField("round_trip", T.BooleanType())] * check

    def make():
        model = unigram_of(shared.value)
        is_byte = np.array([k == BYTE for k in model.pieces.kind])

        def run(batches):
            for batch in common.slices(batches, limit=2 << 20):
                texts = batch.column("text").to_pylist()
                ids = model.encode_batch(texts)
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                byte = np.concatenate([[0], np.cumsum(is_byte[flat])])
                batch = batch.append_column("pieces", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                batch = batch.append_column("n_byte_pieces", pa.array(byte[ends[1:]] - byte[ends[:-1]]))
                if check:
                    batch = batch.append_column("round_trip", pa.array([model.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]))
                yield batch
                common.release()

        return run

    return common.map_whole(docs, make, *fields)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with text, decoded from pieces (null: null), in place of a column of that name."""
    encoded = encoded.drop("text")
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        model = unigram_of(shared.value)

        def run(batches):
            for batch in batches:
                text = [None if x is None else model.decode(np.array(x, "<i4").tobytes()) for x in batch.column("pieces").to_pylist()]
                yield batch.append_column("text", pa.array(text, pa.string()))

        return run

    return common.map_whole(encoded, make, T.StructField("text", T.StringType()))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (of ids as little-endian int32), round_trip of every document."""
    from public_tokenizers import path

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(read_model(path("piece_bpe_32k.model")))

    def run(batches):
        model = unigram_of(shared.value)
        is_byte = np.array([k == BYTE for k in model.pieces.kind])
        for batch in common.slices(batches, limit=2 << 20):
            texts = batch.column("text").to_pylist()
            ids = model.encode_batch(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "n_byte_pieces": pa.array([int(is_byte[np.frombuffer(x, "<i4")].sum()) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                "round_trip": pa.array([model.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]),
            })

    return docs.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


QUERIES = {"op8_sentence_pieces": op8_sentence_pieces}
