"""Canonical length-limited Huffman codes: lengths by package-merge, numpy packing, table-driven decoding in lanes.

Codes are at most LIMIT bits. Each document's bits begin at a whole byte. Of every INTERVAL ids of a document the
number of bits is kept, so that a decoder starts at each of these checkpoints and all lanes advance together.
"""

from __future__ import annotations

import numpy as np

LIMIT = 16
INTERVAL = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths under the limit for all symbols with a count (0 for the others)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.int64)
    row, levels = leaf, []
    for level in range(limit):
        if level:
            pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaf, pairs])
            order = np.argsort(both, kind="stable")
            row, is_leaf = both[order], order < n
        else:
            is_leaf = np.ones(n, bool)
        levels.append(is_leaf)
    take, length = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[0] += 1
        length[leaves] -= 1
        take = 2 * (take - leaves)
    out[used] = np.cumsum(length)[:n]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        l = lengths[order].astype(np.int64)
        width = int(l[-1])
        step = np.uint64(1) << (width - l).astype(np.uint64)  # each code's share of the full width
        codes[order] = (np.cumsum(step) - step) >> (width - l).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bits of all documents, bytes of each, bits of each group of INTERVAL ids, groups of each); sizes: ids of each document, over 0."""
    l = lengths[ids].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    end = np.cumsum(l)
    begin = end - l
    bits = np.add.reduceat(l, first)
    n_bytes = (bits + 7) // 8
    at = np.concatenate([[0], np.cumsum(n_bytes)])
    pos = begin + np.repeat(8 * at[:-1] - begin[first], sizes)
    groups = (sizes + INTERVAL - 1) // INTERVAL
    nth = np.arange(groups.sum()) - np.repeat(np.concatenate([[0], np.cumsum(groups)[:-1]]), groups)
    group_bits = np.add.reduceat(l, np.repeat(first, groups) + nth * INTERVAL)
    out = np.zeros(int(at[-1]) // 8 + 2, np.uint64)
    code, word = codes[ids], pos >> 6
    shift = 64 - (pos & 63) - l
    over = shift < 0
    part = np.where(over, code >> np.maximum(-shift, 0).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64))
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[new]] = np.bitwise_or.reduceat(part, new)
    over = np.flatnonzero(over)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.byteswap().tobytes()[: int(at[-1])], n_bytes, group_bits, groups


class Decoder:
    """A table of 2**width entries: the symbol and length for each next width bits."""

    def __init__(self, lengths: np.ndarray):
        self.width = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        share = 1 << (self.width - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.ones(1 << self.width, np.int64)
        self.symbol[: share.sum()] = np.repeat(order, share)
        self.length[: share.sum()] = np.repeat(lengths[order], share)

    def unpack(self, data: bytes, sizes: np.ndarray, n_bytes: np.ndarray, group_bits: np.ndarray) -> np.ndarray:
        """Ids of all documents; every group is decoded on its own from its bit offset."""
        rows = len(data) // 8 + 1
        raw = data + bytes(16)
        window = np.empty((rows, 8), np.uint64)  # the 64 bits from each byte on
        for k in range(8):
            window[:, k] = np.frombuffer(raw, ">u8", rows, k)
        window = window.reshape(-1)
        groups = (sizes + INTERVAL - 1) // INTERVAL
        firsts = np.concatenate([[0], np.cumsum(groups)[:-1]])
        nth = np.arange(groups.sum()) - np.repeat(firsts, groups)
        start = np.cumsum(group_bits) - group_bits
        pos = start - np.repeat(start[firsts] - 8 * (np.cumsum(n_bytes) - n_bytes), groups)
        left = np.minimum(INTERVAL, np.repeat(sizes, groups) - nth * INTERVAL)
        to = np.cumsum(left) - left
        out = np.zeros(int(left.sum()), np.uint32)
        order = np.argsort(-left, kind="stable")
        pos, to, left = pos[order], to[order], left[order]
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, "left"))  # lanes with ids left stand first
            p = pos[:n]
            code = (window[p >> 3] >> (64 - self.width - (p & 7)).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
            code = code.astype(np.int64)
            out[to[:n] + step] = self.symbol[code]
            pos[:n] = p + self.length[code]
        return out
