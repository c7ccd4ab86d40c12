import math

import numpy as np
import pytest

from fathomline.llm import ann, exact_topk, tiles

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block int, score string"


def made(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1, "s") for i, v in vectors], SCHEMA)


def usable(v, zero):
    return v and all(x is not None and math.isfinite(x) for x in v) and len(v) == 6 and (zero or any(v))


def brute(vectors, change, zero, k):
    rows = [(i, [change(x) for x in np.float32(v).astype(float)]) for i, v in vectors if i is not None and usable(v, zero)]
    out = set()
    for q in {i for i, _ in rows if i % 20 == 0}:
        mine = min((np.array(v, "<f8").tobytes(), v) for i, v in rows if i == q)[1]
        scores = []
        for i, v in rows:
            if i != q:
                s = 0.0
                for a, b in zip(mine, v, strict=True):
                    s += a * b
                scores.append((-s, i))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(300, 400)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5), (405, [0.0] * 6), (406, [1.0, 2.0]), (None, [1.0] * 6), (407, [0.0] * 6), (420, [0.0] * 6)]
    return rows + rows[:25]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("search,change,zero", [(exact_topk.voronoi_topk, lambda x: math.floor(64 * x), True), (ann.block_join, lambda x: x, False)])
def test_as_brute_force(spark, vectors, search, change, zero, small, monkeypatch):
    if small:
        monkeypatch.setattr(tiles, "QUERY_BLOCK", 4)
        monkeypatch.setattr(tiles, "DATA_CHUNK", 37)
    got = search(made(spark, vectors), k=7).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(vectors, change, zero, 7)


@pytest.mark.parametrize("search", [exact_topk.voronoi_topk, ann.block_join])
def test_few_rows(spark, search):
    assert search(made(spark, [])).count() == 0
    assert search(made(spark, [(20, [1.0, 2.0])])).count() == 0
    assert [tuple(r)[:3] for r in search(made(spark, [(20, [1.0, 2.0]), (3, [1.0, 1.0])])).collect()] == [(20, 1, 3)]


def test_large_integers(spark):
    v = [(i, [float(2**40 + i), 1.0]) for i in (1, 2, 20)]
    got = sorted(tuple(r) for r in exact_topk.voronoi_topk(made(spark, [(i, [x / 2**20 for x in e]) for i, e in v])).collect())
    assert [r[2] for r in got] in ([1, 2], [2, 1]) and len(got) == 2


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((30, 64)), rng.standard_normal((500, 64)) * rng.random((500, 1)) * 9
    got = ann.best(np.arange(0, 600, 20), q, np.arange(1000, 1500), x, k=5)
    want = np.argsort(-(q @ x.T), 1)[:, :5]
    assert (got[1].reshape(30, 5) == 1000 + want).all()
