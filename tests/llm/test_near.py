import random
import re

import numpy as np
import pytest

from fathomline.llm import common, graph, near_dups
from fathomline.llm.near_dups import Family


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def expected(rows):
    """doc_id, n_shingles, component of rows without null ids."""
    sets = [shingles(t) for _, t in rows]
    comp = components(sets)
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least[c] = min(d, least.get(c, d))
    return sorted((d, len(s), least[c] if s else d) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def star(rng, n, words=100, changes=2):
    base = [f"s{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(words)] = f"c{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = star(rng, 30) + star(rng, 40, 60, 1) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(30)] + ["same text of seven words for all"] * 20 + ["", " ", "a b", "A  B", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [near_dups.FAMILY, 400])
def test_components_are_exact(spark, limit, monkeypatch):
    monkeypatch.setattr(near_dups, "FAMILY", limit)  # 400: families are split over tasks
    rows = corpus(3)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == expected([r for r in rows if r[0] is not None])
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    left = near_dups.dedup(odd)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == odd.columns and sorted(i for i in ids if i is not None) == sorted({c for *_, c in expected([r for r in rows if r[0] is not None])} & {r[0] for r in rows}) and ids.count(None) == 2
    assert near_dups.near_duplicates(none).count() == 0 and near_dups.dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_a_family_in_memory(seed):
    rng = random.Random(seed)
    base = rng.sample(range(2000), 60)
    sets = []
    for _ in range(rng.choice([2, 3, 40])):
        kind = rng.random()
        s = set(base)
        if kind < 0.6:
            for _ in range(rng.randint(0, 12)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(2000, 2200))
        elif kind < 0.8:
            s = set(rng.sample(range(2300), 60))
        else:
            s = set(rng.sample(base, 40)) | set(range(3000, 3020 + rng.randint(0, 6)))
        sets.append(s)
    flat = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in sets])
    assert Family(flat, np.array(list(map(len, sets)))).root.tolist() == components(sets)


def test_shingles_of_bytes():
    import pyarrow as pa

    texts = ["A b c d e f", "a B  c\td e\nf", "a b c d e", "a b", "ab", None, "é É x y z w", "a b c d e a b c d e", "\x00 \x0b a"]
    flat, sizes = near_dups.shingle_sets(pa.array(texts))
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(parts[i].tolist()) & set(parts[j].tolist())) == len(shingles(a) & shingles(b))


def test_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_bitmap_never_says_no_to_a_member(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "x")
    rows = spark.range(20_000)
    test = common.may_hold(ids, "x")
    got = {r["id"] for r in rows.where(test(rows["id"])).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 4000


def reachable(sets, percent):
    """Least index of each set's component, by links from percent on."""
    links = [[j for j, b in enumerate(sets) if a and 100 * len(a & b) >= percent * len(a | b)] for a in sets]
    out = list(range(len(sets)))
    for i in range(len(sets)):
        todo = [i] if out[i] == i else []
        while todo:
            todo += [j for j in links[todo.pop()] if out[j] > i and not out.__setitem__(j, i)]
    return out


def graded(seed, percents=range(76, 92)):
    """Pairs of 200 words whose shingle sets have similarities from under 0.8 to over 0.85, and a star."""
    rng = random.Random(seed)
    texts = star(rng, 20, 100, 2)
    for p in percents:
        for _ in range(3):
            base = [f"g{rng.randrange(10**9)}" for _ in range(200)]
            tail = round(196 * (1 - p / 100) / (1 + p / 100))  # this many last words differ
            texts += [" ".join(base), " ".join(base[: 200 - tail] + [f"h{rng.randrange(10**9)}" for _ in range(tail)])]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [near_dups.FAMILY, 400])
@pytest.mark.parametrize("percent", [80, 85])
def test_links_from_a_given_percentage_on(spark, percent, limit, monkeypatch):
    monkeypatch.setattr(near_dups, "FAMILY", limit)
    rows = graded(5)
    want = reachable([shingles(t) for _, t in rows], percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, limit, percent).collect()}
    assert [got[d] for d, _ in rows] == want
    assert want != reachable([shingles(t) for _, t in rows], 165 - percent)


def test_the_forest_misses_no_more_at_a_lower_threshold():
    assert near_dups.forest(85) == (9, 40)
    for percent in range(50, 101):
        depth, trees = near_dups.forest(percent)
        assert (1 - (percent / 100) ** depth) ** trees <= 3e-5


def test_the_stage_drops_copies_from_080_on(spark):
    import corpus_pipeline as pipe

    rows = graded(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in pipe.drop_near_duplicates(spark, docs, "").collect()}
    assert left == set(reachable([shingles(t) for _, t in rows], 80))


@pytest.mark.parametrize("most", [2, 10])
def test_crowded_regions_are_exact_too(spark, most, monkeypatch):
    monkeypatch.setattr(near_dups, "CROWDED", most)
    monkeypatch.setattr(near_dups, "CHUNK", 50)
    rows = corpus(8)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected(rows)


def test_neighbours_as_by_hand():
    rng = np.random.default_rng(5)
    values = np.sort(rng.integers(0, 3, (400, 14)).astype(np.uint8).view("S14").ravel()).view(np.uint8).reshape(-1, 14)
    values = values[np.lexsort(values.T[::-1])]
    left, right = (sum(values[:, a + k].astype(np.uint64) << np.uint64(8 * (n - 1 - k)) for k in range(n)).view(np.int64) for a, n in ((0, 6), (6, 8)))
    common_prefix = [int(np.argmin(np.append(x == y, False))) for x, y in zip(values[:-1], values[1:])]
    near, crowded = near_dups.neighbours(left, right, 2, 4, 12)

    def region(i, depth):
        return sum((values[:, :depth] == values[i, :depth]).all(1))

    for i, n in enumerate(common_prefix):
        assert near[i] == any(n >= d and (region(i, d) <= 12 or d == 4) for d in (2, 3, 4))
    assert crowded.tolist() == [region(i, 2) > 12 for i in range(400)]
