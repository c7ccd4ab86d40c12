"""Near duplicates of word shingles by an LSH forest of MinHash signatures, confirmed on full sets.

1. Each whole text becomes the set of its 5-word shingles (64-bit hashes), a fingerprint of that set and a key for each
   of a number of orders: MinHash values, 8 bits each, as many as the greatest depth.
2. Texts with equal sets count once, as the smallest doc_id (aggregated before the shuffle).
3. Each order is sorted by key, over all tasks (by ranges of key, so a crowded region is many tasks), and every key is
   compared with its neighbour. A region is a run of keys whose neighbours share a prefix of the base depth. In a region
   of at most CROWDED keys all neighbours are candidates. In a crowded one the depth grows, part by part, until a
   part is not crowded or the greatest depth is reached; neighbours within a part are candidates. As only their
   components count, they are written as edges to the smallest doc_id of the part, which are sooner contracted.
   A link shares no prefix of the base depth in any order with probability 3e-5 (`forest`). A greater depth loses more,
   so the texts of crowded regions are sorted in further orders, as many as the greatest depth needs to lose as little.
   Region sizes are counted within a task; where a task or a chunk ends inside a region, that only makes more candidates.
4. The components of the candidates are families: every link lies within a family, apart from those missed in 3.
   Families are resolved on full sets, whole. A family of at most FAMILY shingles is one piece of a task's work:
   - The shingles that more than half of the family have form a core. If the differences of two sets from the core
     have nothing in common, whether they link depends on the sizes alone, and then both link with the hub, the set
     nearest the core. So all are compared with the hub, and those left over again among themselves, as long as a
     good part links. This finds stars of thousands of copies around one text, without pairs.
   - What is in different components still is joined by prefix filtering (a link shares one of the rarest shingles of
     both sets), which is exact.
   A larger family is split: core of a bounded number of members, hub, comparison with the hub row by row; the sets
   left over are then compared with all of the family in tiles of at most FAMILY shingles a side.
5. Links outside small families are joined to components.

The texts of families (told from others by a bitmap of bounded size first) are shuffled twice, those of crowded regions
once more; of all others only fingerprints and keys are. The driver gets two keys of each task, for neighbours in
different tasks.

Texts without words, null texts: n_shingles 0, linked with nothing. Rows with null doc_id: likewise, component null,
kept. Rows that repeat a doc_id and text are all returned. Other columns are ignored, and kept by `dedup`.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components_at

WORDS = 5
#: Links: 100 * intersection >= percent * union; PERCENT where none is given.
PERCENT = 85
#: Base depth at PERCENT, and how probably a link at any threshold may share no prefix of a depth.
DEPTH, MISS = 9, 3e-5
#: Keys that share a prefix from which on a region is crowded; rows of an order that are compared at a time.
CROWDED, CHUNK = 128, 1 << 20
#: A key's values: LEFT of them stand beside the order's number in its first half, the others in its second.
LEFT, MOST = 6, 14
#: Shingles of a family (or of one side of a tile) that a task holds.
FAMILY = 250_000
#: Members of a large family from which its core is taken.
CORE = 64

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.array([pow(int(_STEP), k, 1 << 64) for k in range(WORDS)], np.uint64)


def orders_for(percent: int, depth: int) -> int:
    """Orders with which a link at percent shares a prefix of this depth in one of them, but for MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** depth)))


def forest(percent: int) -> tuple[int, int]:
    """(base depth, orders) for links from percent on: shallower below PERCENT, and as many orders as MISS needs."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent {percent} isn't from 1 to 100")
    depth = max(1, round(DEPTH * percent / PERCENT))
    return depth, orders_for(percent, depth)


def deepest(percent: int) -> int:
    """The greatest depth: half as much again as the base, and MOST at most."""
    return min(MOST, -(-3 * forest(percent)[0] // 2))


@functools.cache
def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a, b = (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1) for _ in range(2))
    return a, b


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows' distinct shingles, ascending in each row; number of each row)."""
    value, starts, *_ = common.word_hashes(column)
    n_words = np.diff(starts)
    rows = np.repeat(np.arange(len(n_words)), n_words)
    nth = np.arange(len(value)) - starts[rows]
    acc = np.zeros(len(value), np.uint64)
    short = (n_words < WORDS)[rows]
    for k in range(WORDS):  # a short row's one shingle takes all its words, and zeros beyond
        here = np.zeros(len(value), np.uint64)
        here[: max(0, len(value) - k)] = value[k:]
        if k:
            here[nth + k >= n_words[rows]] = 0
        acc += here * _POWERS[k]
    use = np.where(short, nth == 0, nth <= n_words[rows] - WORDS)
    acc = common.mix64(acc[use] + np.minimum(n_words[rows[use]], WORDS).astype(np.uint64))
    count = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        acc[a:b].sort()
    row = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])
    return acc[new], np.bincount(row[new], minlength=len(count))


def order_keys(flat: np.ndarray, sizes: np.ndarray, orders: range, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the key of each row and order: the order's number and LEFT values, then the others (rows without shingles: zeros)."""
    first, second = _orders(depth * orders.stop)
    full = np.flatnonzero(sizes)
    left, right = (np.zeros((len(sizes), len(orders)), np.uint64) for _ in range(2))
    if not len(full):
        return left.view(np.int64), right.view(np.int64)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for i, order in enumerate(orders):
        half = [np.full(len(full), order, np.uint64) << np.uint64(8 * LEFT), np.zeros(len(full), np.uint64)]
        for k in range(depth):
            at = order * depth + k
            least = np.minimum.reduceat(low * first[at] + high * second[at], starts)
            value = common.mix64(least.astype(np.uint64) + _STEP) >> np.uint64(56)
            half[k >= LEFT] |= value << np.uint64(8 * (LEFT - 1 - k if k < LEFT else MOST - 1 - k))
        left[full, i], right[full, i] = half
    return left.view(np.int64), right.view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, print, lefts, rights) of each whole text: its keys in all orders."""
    orders, depth = range(forest(percent)[1]), deepest(percent)

    def make():
        def run(batches):
            for batch in common.slices(batches, limit=2 << 20):
                flat, sizes = shingle_sets(batch.column("text"))
                ends = np.cumsum(sizes)
                marks = [hashlib.blake2b(flat[e - n : e].tobytes(), digest_size=16).digest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                left, right = order_keys(flat, sizes, orders, depth)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), _lists(left), _lists(right)], names=["doc_id", "n_shingles", "print", "lefts", "rights"])

        return run

    return common.map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, print binary, lefts array<long>, rights array<long>")


# --- the forest ----------------------------------------------------------------------------------------------------


def same_prefix(left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Whether neighbours in a sorted order have this many values in common."""
    x = (left[1:] ^ left[:-1]).view(np.uint64)
    if depth <= LEFT:
        return x >> np.uint64(8 * (LEFT - depth)) == 0
    return (x == 0) & ((right[1:] ^ right[:-1]).view(np.uint64) >> np.uint64(8 * (MOST - depth)) == 0)


def neighbours(left: np.ndarray, right: np.ndarray, base: int, deep: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each sorted key and the next are candidates, whether each key's region is crowded)."""
    near, crowded = np.zeros(max(0, len(left) - 1), bool), np.zeros(len(left), bool)
    for depth in range(base, deep + 1):
        same = same_prefix(left, right, depth)
        part = np.concatenate([[0], np.cumsum(~same)])
        many = np.bincount(part)[part] > most
        if depth == base:
            crowded = many
        near |= same & ~many[1:] if depth < deep else same
    return near, crowded


def candidates(keys: DataFrame, base: int, deep: int, most: int | None = None) -> tuple[DataFrame, str]:
    """((a, b) of candidates, and (a, null) of texts in crowded regions; path) for keys(left, right, rep)."""
    most, chunk = CROWDED if most is None else most, CHUNK
    ordered = keys.repartitionByRange("left", "right", "rep").sortWithinPartitions("left", "right", "rep")
    schema = "a long, b long, part int, place int, left long, right long, crowded boolean"

    def told(a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        part, ends, before = TaskContext.get().partitionId(), [], None
        for left, right, rep in chunks(batches):
            near, crowded = neighbours(left, right, base, deep, most)
            starts = np.flatnonzero(np.concatenate([[True], ~near]))
            least = np.repeat(np.minimum.reduceat(rep, starts), np.diff(np.append(starts, len(rep))))
            yield told(rep[rep != least], pa.array(least[rep != least]))
            alone = np.unique(rep[crowded])
            yield told(alone, pa.nulls(len(alone), pa.int64()))
            first, last = ((int(left[k]), int(right[k]), int(rep[k]), bool(crowded[k])) for k in (0, -1))
            if before and meet(before, first, base, deep):
                yield told(np.array([before[2]]), pa.array([first[2]], pa.int64()))
            ends, before = [ends[0] if ends else first, last], last
        if ends:
            columns = list(zip(*ends, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[2], pa.int64()), pa.nulls(2, pa.int64()), pa.array([part] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[3])], names=[x.split()[0] for x in schema.split(", ")])

    def chunks(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield arrays(held)
                held, n = [], 0
        if n:
            yield arrays(held)

    def arrays(held):
        rows = pa.Table.from_batches(held)
        return tuple(rows.column(c).to_numpy() for c in ("left", "right", "rep"))

    found, at = common.write_table(ordered.mapInArrow(run, schema), "candidates")
    ends = sorted(found.where("part is not null").select("part", "place", "left", "right", "a", "crowded").collect())  # two rows of each task
    ends = [(r["left"], r["right"], r["a"], r["crowded"]) for r in ends]
    across = [(x[2], y[2]) for x, y in zip(ends[1::2], ends[2::2], strict=False) if meet(x, y, base, deep)]
    out = found.where("part is null").select("a", "b")
    return (out.union(keys.sparkSession.createDataFrame(across, "a long, b long")) if across else out), at


def meet(x: tuple, y: tuple, base: int, deep: int) -> bool:
    """Whether the last key of one run of rows and the first of the next (left, right, rep, crowded) are candidates."""
    left, right = (np.array([x[k], y[k]], np.int64) for k in (0, 1))
    return bool(same_prefix(left, right, deep if x[3] or y[3] else base)[0])


def further_keys(docs: DataFrame, percent: int) -> DataFrame:
    """(left, right, rep) of docs(rep, text) in the orders beyond the forest's that its greatest depth needs."""
    deep = deepest(percent)
    orders = range(forest(percent)[1], orders_for(percent, deep))

    def make():
        def run(batches):
            for batch in common.slices(batches, limit=1 << 20):
                flat, sizes = shingle_sets(batch.column("text"))
                full = sizes > 0
                left, right = order_keys(flat, sizes, orders, deep)
                rep = batch.column("rep").to_numpy()[full]
                yield pa.RecordBatch.from_arrays([pa.array(left[full].ravel()), pa.array(right[full].ravel()), pa.array(np.repeat(rep, len(orders)))], names=["left", "right", "rep"])

        return run

    return common.map_arrow(docs.select("rep", "text"), make, "left long, right long, rep long")


def candidate_edges(reps: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """((a, b) of candidates, paths): reps(rep, lefts, rights), texts(rep, text)."""
    base, deep = forest(percent)[0], deepest(percent)
    keys = reps.select("rep", F.explode(F.arrays_zip("lefts", "rights")).alias("k")).select(F.col("k.lefts").alias("left"), F.col("k.rights").alias("right"), "rep")
    found, found_at = candidates(keys, base, deep)
    crowded, crowded_at = common.write_table(found.where("b is null").select(F.col("a").alias("rep")).distinct(), "crowded")
    edges, paths = found.where("b is not null"), [found_at, crowded_at]
    if deep > base and not crowded.isEmpty():
        theirs = texts.where(common.may_hold(crowded, "rep")(F.col("rep"))).join(crowded.hint("merge"), "rep")
        more, more_at = common.write_table(further_keys(theirs, percent), "further")
        again, again_at = candidates(more, deep, deep)
        edges, paths = edges.union(again.where("b is not null")), [*paths, more_at, again_at]
    return edges, paths


# --- one family in memory ------------------------------------------------------------------------------------------


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


class Family:
    """Components of a family's sets: `root` gives each set's smallest index reachable by links."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.n, self.size, self.percent = len(sizes), sizes.astype(np.int64), percent
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.parent = np.arange(self.n)
        if self.n == 2:
            both = len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))
            if linked(both, *self.size, percent):
                self.parent[1] = 0
        elif self.n > 2:
            values, self.token = np.unique(flat, return_inverse=True)
            self.n_tokens = len(values)
            self.by_hubs()
            self.by_prefixes()
        self.root = np.array([self.find(i) for i in range(self.n)])

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def tokens(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of these sets, start of each)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(self.at[ids] - (ends - size), size)
        return self.token[place], ends - size

    def shared(self, mark: np.ndarray, token: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mark[token].astype(np.int64), start)

    def by_hubs(self) -> None:
        left = np.arange(self.n)
        while len(left) > 1:
            token, start = self.tokens(left)
            core = np.bincount(token, minlength=self.n_tokens) * 2 > len(left)
            size = self.size[left]
            far = size + core.sum() - 2 * self.shared(core, token, start)
            hub = left[np.argmin((100 + self.percent) * far - (100 - self.percent) * size)]
            mark = np.zeros(self.n_tokens, bool)
            mark[self.tokens(np.array([hub]))[0]] = True
            link = linked(self.shared(mark, token, start), size, self.size[hub], self.percent)
            for i in left[link].tolist():
                self.join(i, int(hub))
            rest = left[~link]
            if 10 * (len(left) - len(rest)) < len(left):
                break
            left = rest

    def by_prefixes(self) -> None:
        root = np.array([self.find(i) for i in range(self.n)])
        if (root == root[0]).all():
            return
        often = np.bincount(self.token, minlength=self.n_tokens)
        rank = np.empty(self.n_tokens, np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(self.n_tokens)
        doc = np.repeat(np.arange(self.n), self.size)
        order = np.lexsort((rank[self.token], doc))
        nth = np.arange(len(doc)) - self.at[doc]
        length = self.size - (self.percent * self.size + 99) // 100 + 1
        use = nth < length[doc]
        token, doc = self.token[order][use], doc[use]
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
        mark = np.zeros(self.n_tokens, bool)
        seen: set[tuple[int, int]] = set()
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            docs = doc[a:b]
            own = root[docs]
            if (own == own[0]).all():
                continue
            for k, i in enumerate(docs[:-1].tolist()):
                top = self.find(i)
                others = docs[k + 1 :]
                small, large = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
                others = [j for j in others[100 * small >= self.percent * large].tolist() if (i, j) not in seen and self.find(j) != top]
                if not others:
                    continue
                mine = self.token[self.at[i] : self.at[i + 1]]
                mark[mine] = True
                for lo in range(0, len(others), 256):
                    ids = np.array([j for j in others[lo : lo + 256] if self.find(j) != self.find(i)], np.int64)
                    if not len(ids):
                        continue
                    tokens, start = self.tokens(ids)
                    link = linked(self.shared(mark, tokens, start), self.size[ids], self.size[i], self.percent)
                    for j in ids[link].tolist():
                        self.join(i, j)
                    seen.update((i, j) for j in ids[~link].tolist())
                mark[mine] = False


def _resolved(docs: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(rep, component) within each key of docs(key, rep, print, text or set), each key whole in one task."""
    has_text = "text" in docs.columns
    content = "text" if has_text else "set"
    dealt = docs.repartition(*key).sortWithinPartitions(*key, "rep")

    def make():
        def solve(held):
            reps, sets, prints = [], [], set()
            for rep, mark, s in held:
                if (rep, mark) not in prints:
                    prints.add((rep, mark))
                    reps.append(rep)
                    sets.append(s)
            root = Family(np.concatenate(sets), np.array([len(s) for s in sets]), percent).root
            reps = np.array(reps, np.int64)
            least = reps.copy()
            np.minimum.at(least, root, reps)
            return reps, least[root]

        def run(batches):
            now, held, out = None, [], []
            for batch in common.slices(batches, content):
                if has_text:
                    flat, sizes = shingle_sets(batch.column("text"))
                    sets = np.split(flat, np.cumsum(sizes)[:-1])
                else:
                    sets = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
                marks = batch.column("print").to_pylist()
                for k, rep, mark, s in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), batch.column("rep").to_pylist(), marks, sets, strict=True):
                    if has_text and hashlib.blake2b(s.tobytes(), digest_size=16).digest() != mark:
                        continue  # another text under the same doc_id
                    if k != now:
                        if held:
                            out.append(solve(held))
                        now, held = k, []
                    held.append((rep, mark, s))
                if len(out) > 1000:
                    yield told(out)
                    out = []
            if held:
                out.append(solve(held))
            if out:
                yield told(out)

        def told(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], names=["rep", "component"])

        return run

    return common.map_arrow(dealt.select(*key, "rep", "print", content), make, "rep long, component long")


# --- families that are split ---------------------------------------------------------------------------------------


def _distance(rows: DataFrame, other: str, schema: str, out) -> DataFrame:
    """mapInArrow over rows with binary columns set and `other`; out(batch, shared, size, other's size) gives arrays."""

    def make():
        def run(batches):
            for batch in common.slices(batches, "set"):
                a = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
                b = [np.frombuffer(x, np.uint64) for x in batch.column(other).to_pylist()]
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
                yield out(batch, both, np.array([len(x) for x in a], np.int64), np.array([len(y) for y in b], np.int64))

        return run

    return common.map_arrow(rows, make, schema)


def _large_links(docs: DataFrame, families: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """((a, b) edges, paths): edges that join the components of families too large for a task. docs: family, rep, print, text."""

    def to_sets():
        def run(batches):
            for batch in common.slices(batches):
                flat, sizes = shingle_sets(batch.column("text"))
                mark = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in np.split(flat, np.cumsum(sizes)[:-1])]
                keep = pa.array([x == y for x, y in zip(mark, batch.column("print").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("rep"), batch.column("print"), pa.array(sizes, pa.int64()), common.split_binary(flat.tobytes(), 8 * sizes)], names=["family", "rep", "print", "n", "set"]).filter(keep)

        return run

    sets, sets_at = common.write_table(common.map_arrow(docs.select("family", "rep", "print", "text"), to_sets, "family long, rep long, print binary, n long, set binary"), "sets")
    salt = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
    few = sets.join(families, "family").where(salt * F.col("members") < CORE).select("family", "set")

    def core(pdf):
        import pandas as pd

        flat, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["set"]]), return_counts=True)
        return pd.DataFrame({"family": pdf["family"].iloc[:1], "core": [flat[2 * n > len(pdf)].tobytes()]})

    cores = few.groupBy("family").applyInPandas(core, "family long, core binary")
    near = _distance(sets.join(cores, "family"), "core", "family long, rep long, g long", lambda batch, both, a, b: pa.RecordBatch.from_arrays([batch.column("family"), batch.column("rep"), pa.array((100 + percent) * (a + b - 2 * both) - (100 - percent) * a)], names=["family", "rep", "g"]))
    hubs = near.groupBy("family").agg(F.min(F.struct("g", "rep")).alias("m")).select("family", F.col("m.rep").alias("hub"))
    hubs = hubs.join(sets.select(F.col("rep").alias("hub"), F.col("set").alias("hub_set")), "hub").dropDuplicates(["family"])
    seen, seen_at = common.write_table(_distance(sets.join(hubs, "family", "left").withColumn("hub_set", F.coalesce("hub_set", F.lit(b""))), "hub_set", "family long, rep long, hub long, n long, link boolean", lambda batch, both, a, b: pa.RecordBatch.from_arrays([batch.column("family"), batch.column("rep"), batch.column("hub"), batch.column("n"), pa.array(linked(both, a, b, percent) & (b > 0))], names=["family", "rep", "hub", "n", "link"])), "seen")
    rest = seen.where(~F.col("link"))
    edges = seen.where("link").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    if rest.isEmpty():
        return edges, [sets_at, seen_at]
    parts = rest.groupBy("family").agg(F.ceil(F.sum("n") / FAMILY).cast("int").alias("blocks")).join(families, "family").withColumn("chunks", F.ceil(F.col("shingles") / FAMILY).cast("int"))
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("rep")), F.col(n)).cast("int")
    every = sets.join(parts, "family")
    a_side = every.join(rest.select("rep"), "rep", "left_semi").withColumn("block", place(1, "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    b_side = every.withColumn("chunk", place(2, "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["family", "block", "chunk", "rep", "print", "set"]
    tiles = _resolved(a_side.select(columns).union(b_side.select(columns)), ["family", "block", "chunk"], percent)
    return edges.union(tiles.select(F.col("rep").alias("a"), F.col("component").alias("b"))), [sets_at, seen_at]


# --- the operator --------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, family_limit: int = FAMILY, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text); texts link from percent on."""
    signed, signed_at = common.write_table(signatures(docs, percent), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps, reps_at = common.write_table(full.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "lefts", "rights")).alias("m"), F.count(F.lit(1)).alias("copies")).select("print", "copies", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.lefts").alias("lefts"), F.col("m.rights").alias("rights")), "reps")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").where(F.col("rep").isNotNull())
    edges, paths = candidate_edges(reps, texts, percent)
    families, families_at = components_at(edges)
    members, members_at = common.write_table(families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(reps.select("rep", "print", "n"), "rep"), "members")
    sizes = members.groupBy("family").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"))
    large, large_at = common.write_table(sizes.where(F.col("shingles") > family_limit), "large")
    paths += [signed_at, reps_at, *families_at, members_at, large_at]
    any_large = not large.isEmpty()
    texts = texts.where(common.may_hold(members, "rep")(F.col("rep")))  # others' texts aren't shuffled
    small = members.join(large.select("family"), "family", "left_anti") if any_large else members
    found = _resolved(texts.join(small.hint("merge"), "rep"), ["family"], percent)
    if any_large:
        edges, more = _large_links(texts.join(members.join(large.select("family"), "family"), "rep"), large, percent)
        joined, joined_at = components_at(edges)
        found, paths = found.union(joined.select(F.col("node").alias("rep"), "component")), [*paths, *more, *joined_at]
    found, found_at = common.write_table(found, "found")
    by_print = reps.select("print", "copies", "rep").join(found.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left").select("print", "copies", F.coalesce("component", "rep").alias("component"))
    out = _by_print(full, by_print).union(signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out, _ = common.write_table(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    common.delete(docs.sparkSession, *paths, found_at)
    return out


def _by_print(rows: DataFrame, by_print: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows. Fingerprints of more than a thousandth of all rows, a thousand at most, are joined without a shuffle."""
    many = rows.count() // 1000 + 1
    hot = by_print.where(F.col("copies") > many).select(F.col("print").alias("hot_print"), F.col("component").alias("hot"))
    marked = rows.select("doc_id", "n_shingles", "print").join(F.broadcast(hot), F.col("print") == F.col("hot_print"), "left")
    rest = marked.where("hot is null").select("doc_id", "n_shingles", "print").join(by_print.where(F.col("copies") <= many), "print")
    return marked.where("hot is not null").select("doc_id", "n_shingles", F.col("hot").alias("component_id")).union(rest.select("doc_id", "n_shingles", F.col("component").alias("component_id")))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each component the smallest doc_id stays, and one row of it if rows repeat it."""
    found = near_duplicates(docs, percent=percent)
    again = not found.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty()
    gone, _ = common.write_table(found.where("not kept").select("doc_id").distinct(), "gone")
    maybe = F.col("doc_id").isNotNull() & common.may_hold(gone, "doc_id")(F.col("doc_id"))
    out = docs.where(~maybe).union(docs.where(maybe).join(gone.hint("merge"), "doc_id", "left_anti").select(common.columns(docs)))  # texts that surely stay aren't shuffled
    if again:
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))
    return out


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), percent=PERCENT)


#: The same by brute force: all pairs that share a shingle, and components by recursion.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, b AS other FROM ways
  UNION
  SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS kept
FROM sets s LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY 1) m USING (doc_id)
"""

QUERIES = {"op7_near_dups": op7_near_dups}
SQL = {"op7_near_dups": ORACLE}
