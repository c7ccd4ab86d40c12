import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from fathomline.llm import huffman, token_counts, token_output
from fathomline.llm.pretoken import PretokenCache, load_json

FILE = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def best_lengths(counts, limit):
    """Package-merge by the book."""
    n = len(counts)
    leaf = sorted((c, (i,)) for i, c in enumerate(counts))
    row = leaf
    for _ in range(limit - 1):
        row = sorted(leaf + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])])
    out = [0] * n
    for _, held in row[: 2 * n - 2]:
        for i in held:
            out[i] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths_are_optimal(seed):
    rng = random.Random(seed)
    counts = [int(rng.paretovariate(0.4)) for _ in range(rng.randint(2, 40))]
    got = huffman.code_lengths(np.array(counts), 7)
    assert got.max() <= 7 and sum(2.0 ** -int(x) for x in got) <= 1
    assert sum(int(a) * c for a, c in zip(got, counts)) == sum(a * c for a, c in zip(best_lengths(counts, 7), counts))


@pytest.mark.parametrize("sizes", [[1], [1, 130, 1, 5000], [128, 256, 129]])
def test_pack_and_unpack(sizes):
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, sum(sizes)), 900) - 1
    lengths = huffman.code_lengths(np.bincount(ids, minlength=900), 12)
    data, n_bytes, bits, _ = huffman.pack(ids, np.array(sizes), lengths, huffman.canonical(lengths))
    assert (huffman.Decoder(lengths).unpack(data, np.array(sizes), n_bytes, bits) == ids).all()


def test_one_symbol():
    lengths = huffman.code_lengths(np.array([0, 9]))
    data, n_bytes, bits, _ = huffman.pack(np.ones(9, int), np.array([9]), lengths, huffman.canonical(lengths))
    assert (huffman.Decoder(lengths).unpack(data, np.array([9]), n_bytes, bits) == 1).all()


def test_file_gives_all_ids_back(spark, odd, library, tmp_path):
    at = f"file://{tmp_path}/ids"
    token_output.write_ids(odd, at, FILE, parts=3)
    got = token_output.read_ids(spark, at).collect()
    key = lambda r: (r["start"])
    start = 0
    for r in sorted(got, key=key):
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=key)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in odd.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    bare = token_output.read_ids(spark, at, with_ids=False)
    assert sorted(bare.collect(), key=key) == sorted((r[:4] for r in got), key=lambda r: r[1])


def test_pretokens_give_the_ids_of_the_library(library):
    """Around characters of all kinds, and where white space, marks and letters meet."""
    cache, rng = PretokenCache(load_json(FILE)), random.Random(7)
    some = [*"ab é×÷ªµñßʯͰж日.,'!\n\t 1-\u00a0\u0301", " ", "  ", "don't", "I'LL", ".,", "..."]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(4000)]
    marks = [chr(c) for c in range(0x3000)]
    texts += [f"a {m}b x{m}., {m}, {m}{m}a.\ny., .,{m} e " for m in marks]
    for text in texts:
        assert cache.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, cache.dtype).tobytes(), text


def test_empty_file(spark, none, tmp_path):
    token_output.write_ids(none, f"file://{tmp_path}/ids", FILE)
    assert token_output.read_ids(spark, f"file://{tmp_path}/ids").count() == 0


def test_a_broken_block_is_noticed():
    block = bytearray(token_output.block_bytes([1], [1], [b"\x00"], [b"\x01\x00\x00\x00"], 0))
    block[-6] ^= 1
    with pytest.raises(ValueError):
        token_output.read_block(bytes(block), huffman.Decoder(np.array([1], np.uint8)))


def test_counts_after_random_edits(library):
    cache, rng = PretokenCache(load_json(FILE)), random.Random(11)
    parts = ["a", " ", "  ", "\n", "'s", "'ll", "1", "é", "!", "", "the quick", "\t x", "<|endoftext|>", "日本 ", " 's", " \n a"]
    for _ in range(200):
        tree = token_counts.CountTree("".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 400]))), cache)
        for _ in range(5):
            a = rng.randint(0, len(tree.text))
            tree.edit(a, min(len(tree.text), a + rng.choice([0, 1, 9, 80])), rng.choice(parts) * rng.choice([1, 2, 50]))
            assert tree.n_tokens == len(library.encode(tree.text, add_special_tokens=False).ids)


def test_an_edit_renews_little():
    cache = PretokenCache(load_json(FILE))
    tree = token_counts.CountTree("some words of a long text " * 2000, cache)
    tree.edit(20_000, 20_005, "other")
    assert tree.renewed < 300


def test_counts_of_odd_rows(odd, none, library):
    got = token_counts.count_after_edits(odd, FILE, token_counts.mask_personal).collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert sorted(r["n_tokens"] for r in got) == sorted(map(count, texts))
    after = []
    for t in texts:
        for a, b, new in token_counts.mask_personal(t):
            t = t[:a] + new + t[b:]
        after.append(count(t))
    assert sorted(r["n_tokens_edited"] for r in got) == sorted(after)
    assert token_counts.count_after_edits(none, FILE, token_counts.mask_personal).count() == 0
