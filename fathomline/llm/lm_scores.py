"""A hidden Markov language model over words: Baum-Welch in numpy, counts added up across partitions.

Words (A-Z lower-cased, keyed by 64-bit hashes) are counted over all training documents. The SYMBOLS most frequent are
symbols of their own; every other word is its class, by its last two bytes, and within the class has its smoothed share
(count + 0.1, with one place for words never seen). An end symbol closes each document. The model has STATES states.

Training: in each iteration every task runs scaled forward and backward recursions over its documents and gives the
expected counts, a row for each symbol; they are summed by symbol, and the driver (a row for each symbol: bounded)
sets the new probabilities. The pieces of a document of more than PIECE symbols run at once: products of their transfer
matrices give the state probabilities at each piece's begin and what follows its end, so the counts, those of
transitions between pieces too, are the same as without pieces. Scoring runs the scaled forward recursion over the
whole document. Of a document over LONG symbols it is done on segments at once, as products of their transfer matrices,
which is the same likelihood.

The counts of the FREQUENT most frequent words (ties by hash) are sent to all tasks. Other words of a document are joined with the
counts by hash, after adding up in the document, so no table of all words has to fit anywhere.

Null and empty texts have the end token alone. Rows with null doc_id belong to the training rows. Rows that repeat a
doc_id are documents each. Without training documents N, V and all counts are 0 and states stay as they began. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATES, SYMBOLS, CLASSES, ITERATIONS = 8, 4096, 512, 4
FREQUENT = 200_000
PIECE, LONG, SEGMENT = 512, 16_384, 256
END = SYMBOLS + CLASSES
FOLDS = 10
ADD = 0.1


def classes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of each word, from 0."""
    last = raw[end - 1].astype(np.int64)
    before = np.where(end - start > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.int64)
    lower = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b)
    return (lower(last) * 31 + lower(before) * 7) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(h, class, n) of all words, added up in each task first, in bounded memory."""

    def make():
        def merged(parts):
            h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, c, n = h[order], c[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            return h[first], c[first], np.add.reduceat(n, first) if len(h) else n

        def run(batches):
            parts, held = [], 0
            for batch in common.slices(batches):
                value, _, raw, start, end = common.word_hashes(batch.column("text"))
                parts.append((value, classes(raw, start, end), np.ones(len(value), np.int64)))
                parts = [*parts[:-1], merged(parts[-1:])]
                held += len(parts[-1][0])
                if held > 1_500_000:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > 750_000:
                        yield told(parts[0])
                        parts = []
                    held = sum(len(p[0]) for p in parts)
            if parts:
                yield told(merged(parts))

        def told(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2])], names=["h", "class", "n"])

        return run

    return common.map_arrow(docs.select("text"), make, "h long, class int, n long").groupBy("h").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Lookup:
    """Values for hashes: sorted arrays and binary search; missing: the default."""

    def __init__(self, h: np.ndarray, value: np.ndarray):
        order = np.argsort(h)
        self.h, self.value = h[order], value[order]

    def __call__(self, h: np.ndarray, default):
        if not len(self.h):
            return np.full(len(h), default), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.value[at], default), hit


def prepared(docs: DataFrame, symbols: Lookup, frequent: Lookup) -> DataFrame:
    """A row per document: key, doc_id, held_out, n_tokens, syms (uint16), sums over frequent words, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((symbols, frequent))  # bounded by SYMBOLS and FREQUENT
    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, class_log double, syms binary, rare_h array<long>, rare_n array<int>"

    def make():
        symbol_of, count_of = shared.value

        def run(batches):
            for batch in common.slices(batches):
                value, starts, raw, start, end = common.word_hashes(batch.column("text"))
                h = value.view(np.int64)
                n_rows = batch.num_rows
                n_words = np.diff(starts)
                row = np.repeat(np.arange(n_rows), n_words)
                sym, own = symbol_of(h, 0)
                sym = np.where(own, sym, SYMBOLS + classes(raw, start, end))
                count, known = count_of(h, 0.0)
                log = np.where(known, np.log10(count + ADD), 0.0)
                total = lambda w: np.bincount(row, weights=w, minlength=n_rows)  # noqa: E731, B023
                flat = np.full(len(h) + n_rows, END, np.uint16)
                flat[np.arange(len(h)) + row] = sym
                rare = np.flatnonzero(~known)
                order = np.lexsort((h[rare], row[rare]))
                rr, rh = row[rare][order], h[rare][order]
                first = np.flatnonzero(np.concatenate([[True], (rr[1:] != rr[:-1]) | (rh[1:] != rh[:-1])])) if len(rr) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(rr)]]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rr[first], minlength=n_rows))])
                held = batch.column("held_out")
                yield pa.RecordBatch.from_arrays([
                    batch.column("key"), batch.column("doc_id").cast(pa.int64()), held, pa.array(n_words + 1, pa.int64()), pa.array(total(known).astype(np.int64)),
                    pa.array(total(log)), pa.array(total(np.where(own, 0.0, log))), common.split_binary(flat.tobytes(), 2 * (n_words + 1)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rh[first])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32())),
                ], names=[x.split()[0] for x in schema.split(", ")])

        return run

    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.coalesce(common.fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return common.map_arrow(rows, make, schema)


# --- the model -----------------------------------------------------------------------------------------------------


class Hmm:
    """start, move (from, to) and emit (symbol, state) probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begun(cls, unigram: np.ndarray, states: int = STATES, seed: int = 1) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (unigram[:, None] + ADD) * np.exp(rng.standard_normal((len(unigram), states)))
        move = 0.9 * np.eye(states) + 0.1 / states  # states that last, such as a language or a topic
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start, inner, move, emit) -> Hmm:
        """The next model; inner (states at the begin of later pieces) is only told."""
        move, emit = move + 1.0, emit + ADD / emit.shape[1]
        return cls((start + 1.0) / (start + 1.0).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def transfers(self, text: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Of each column's symbols (live: how many columns still have one) the product of move and emission, up to a factor."""
        k = len(self.start)
        emit = self.emit / self.emit.max(1, keepdims=True)  # so that products stay near 1, and need a look at times only
        out = np.tile(np.eye(k), (text.shape[1], 1, 1))
        for t, m in enumerate(live.tolist()):
            x = np.matmul(out[:m].reshape(m * k, k), self.move).reshape(m, k, k)
            x *= emit[text[t, :m]][:, None, :]
            if t % 16 == 15:
                x /= x.max((1, 2), keepdims=True)
            out[:m] = x
        return out

    def expected(self, syms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Adds the expected counts [start, inner, move, emit] of the sequences."""
        pieces, inside = [], []
        for s in syms:
            for a in range(0, len(s), PIECE):
                pieces.append(s[a : a + PIECE])
                inside.append(a > 0)
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        size = np.array([len(pieces[i]) for i in order])
        inside = np.array(inside)[order]
        n, width, k = len(pieces), int(size[0]), len(self.start)
        text = np.zeros((width, n), np.int64)
        for j, i in enumerate(order):
            text[: size[j], j] = pieces[i]
        live = np.searchsorted(-size, -np.arange(width), "left")
        before, after = self.edges(text, size, live, inside, order)
        alpha, scale = np.zeros((width, n, k)), np.ones((width, n))
        for t in range(width):
            m = live[t]
            prior = np.where(inside[:, None], before @ self.move, self.start) if t == 0 else alpha[t - 1, :m] @ self.move
            a = prior[:m] * self.emit[text[t, :m]]
            scale[t, :m] = s = a.sum(1)
            alpha[t, :m] = a / s[:, None]
        beta = after / (alpha[size - 1, np.arange(n)] * after).sum(1, keepdims=True)
        gamma = np.zeros((width, n, k))
        for t in range(width - 1, -1, -1):
            m = live[t]
            gamma[t, :m] = alpha[t, :m] * beta[:m]
            back = self.emit[text[t, :m]] * beta[:m] / scale[t, :m, None]
            if t:
                counts[2] += self.move * (alpha[t - 1, :m].T @ back)
                beta[:m] = back @ self.move.T
            else:
                counts[2] += self.move * (before[inside].T @ back[inside])
        counts[0] += gamma[0][~inside].sum(0)
        counts[1] += gamma[0][inside].sum(0)
        here = np.arange(width)[:, None] < size
        flat, g = text[here], gamma[here]
        for j in range(k):
            counts[3][:, j] += np.bincount(flat, weights=g[:, j], minlength=len(self.emit))

    def edges(self, text: np.ndarray, size: np.ndarray, live: np.ndarray, inside: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state probabilities at the end of the piece before, likelihood of all pieces after given each state at the end, up to a factor) of each piece."""
        n, k = len(size), len(self.start)
        before, after = np.zeros((n, k)), np.ones((n, k))
        if not inside.any():
            return before, after
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)  # of each piece in its document's order
        later = inside[place]
        at = np.flatnonzero(inside)
        many = np.searchsorted(at, live)  # how many of them still have a symbol
        transfer = np.zeros((n, k, k))
        transfer[at] = self.transfers(text[:, at], many)
        firsts = np.flatnonzero(later[1:] & ~later[:-1])  # first pieces that have another after them
        col = place[firsts]
        state = self.start * self.emit[text[0, col]]
        state /= state.sum(1, keepdims=True)
        for t in range(1, PIECE):  # these are full
            state = (state @ self.move) * self.emit[text[t, col]]
            state /= state.sum(1, keepdims=True)
        begun = dict(zip(firsts.tolist(), state, strict=True))
        for i in range(1, n):
            if later[i]:
                before[place[i]] = begun[i - 1] if not later[i - 1] else self.to_one(before[place[i - 1]] @ transfer[place[i - 1]])
        for i in range(n - 2, -1, -1):
            if later[i + 1]:
                after[place[i]] = self.to_one(transfer[place[i + 1]] @ after[place[i + 1]])
        return before, after

    @staticmethod
    def to_one(x: np.ndarray) -> np.ndarray:
        return x / x.sum()

    def likelihoods(self, syms: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each whole sequence."""
        out = np.zeros(len(syms))
        size = np.array([len(s) for s in syms])
        for i in np.flatnonzero(size > LONG):
            out[i] = self.long_likelihood(syms[i])
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(-size[short], kind="stable")]
        for lo in range(0, len(short), 2000):
            ids = short[lo : lo + 2000]
            n, width = size[ids], int(size[ids[0]])
            text = np.zeros((width, len(ids)), np.uint16)
            for j, i in enumerate(ids):
                text[: n[j], j] = syms[i]
            live = np.searchsorted(-n, -np.arange(width), "left")
            a = np.tile(self.start, (len(ids), 1))
            log = np.zeros(len(ids))
            for t in range(width):
                m = live[t]
                a = a[:m] if t == 0 else a[:m] @ self.move
                a = a * self.emit[text[t, :m]]
                s = a.sum(1)
                a /= s[:, None]
                log[:m] += np.log10(s)
            out[ids] = log
        return out

    def long_likelihood(self, sym: np.ndarray) -> float:
        """The same of one long sequence: segments' transfer matrices at once, then their product."""
        k = len(self.start)
        first = self.start * self.emit[sym[0]]
        rest = sym[1:]
        n = len(rest) // SEGMENT
        parts = rest[: n * SEGMENT].reshape(n, SEGMENT)
        carry, log = np.tile(np.eye(k), (n, 1, 1)), np.zeros(n)
        for t in range(SEGMENT):
            carry = (carry.reshape(n * k, k) @ self.move).reshape(n, k, k) * self.emit[parts[:, t]][:, None, :]
            s = carry.max((1, 2))
            carry /= s[:, None, None]
            log += np.log10(s)
        total, a = log.sum(), first
        for x in carry:
            a = a @ x
            total += np.log10(a.sum())
            a = a / a.sum()
        for s in rest[n * SEGMENT :]:
            a = (a @ self.move) * self.emit[s]
            total += np.log10(a.sum())
            a = a / a.sum()
        return float(total + (np.log10(a.sum()) if not len(rest) else 0.0))


def _syms(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column("syms").to_pylist()]


def iterate(rows: DataFrame, model: Hmm) -> Hmm:
    """One Baum-Welch iteration over rows(syms)."""
    states, n = len(model.start), len(model.emit)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # SYMBOLS + CLASSES + 1 rows
    names = [f"c{j}" for j in range(states)]

    def run(batches):
        counts = [np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((n, states))]
        for batch in common.slices(batches, "syms", 1 << 20):
            shared.value.expected(_syms(batch), counts)
        whole = np.concatenate([counts[3], counts[0][None], counts[1][None], counts[2]])
        used = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(whole[used, j]) for j in range(states))], names=["place", *names])

    got = rows.select("syms").mapInArrow(run, "place int, " + ", ".join(f"{c} double" for c in names)).groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    whole = np.zeros((n + 2 + states, states))
    whole[got["place"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return Hmm.of_counts(whole[n], whole[n + 1], whole[n + 2 :], whole[:n])


def frequent_words(counts: DataFrame, most: int | None = None) -> pd.DataFrame:
    """The `most` most frequent words, in order of count, then hash, without a top list from each task.

    A count that few enough reach is found first, by steps of an eighth of a power of 2, then within the step that goes
    too far. Of the words with that very count the least hashes are taken, by a share of all hashes that holds enough.
    """
    most = FREQUENT if most is None else most
    step = F.floor(F.log2("n") * 8)

    def reach(rows: DataFrame, key, room: int) -> tuple[int | None, int]:
        """(the key that goes beyond room, what is left of the room before it)."""
        for r in sorted(rows.groupBy(key.alias("b")).count().collect(), key=lambda r: -r["b"]):  # a row for each step, or each count of a step
            if r["count"] > room:
                return r["b"], room
            room -= r["count"]
        return None, room

    last, room = reach(counts, step, most)
    if last is None:
        found = counts.toPandas()
    else:
        found = counts.where(step > last).toPandas()
        level, left = reach(counts.where(step == last), F.col("n"), room)
        ties = counts.where(F.col("n") == level)
        found = pd.concat([found, counts.where((step == last) & (F.col("n") > level)).toPandas()])
        share = (2.0 * left + 1000) / ties.count()
        while left:
            upto = min((1 << 63) - 1, int(min(1.0, share) * (1 << 64)) - (1 << 63))
            part = ties.where(F.col("h") <= upto).toPandas()
            if len(part) >= left:
                found = pd.concat([found, part.sort_values("h").iloc[:left]])
                break
            share *= 4
    return found.astype({"h": "int64", "n": "int64", "class": "int64"}).sort_values(["n", "h"], ascending=[False, True], ignore_index=True)


def scored(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    train = docs.where(F.coalesce(common.fold(F.col("doc_id"), FOLDS) != 0, F.lit(True)))
    counts, counts_at = common.write_table(count_words(train), "counts")
    n_train = train.select("doc_id").count()
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # CLASSES rows
    top = frequent_words(counts)
    own = top.iloc[:SYMBOLS]
    n_all, v_all = int(by_class["n"].sum()) + n_train, int(by_class["v"].sum()) + (n_train > 0)
    unigram, room, kinds = np.zeros(END + 1), np.zeros(CLASSES), np.zeros(CLASSES)
    unigram[: len(own)], unigram[END] = own["n"], n_train
    at = by_class["class"].to_numpy(np.int64)
    room[at], kinds[at] = by_class["n"], by_class["v"]
    np.subtract.at(room, own["class"].to_numpy(np.int64), own["n"].to_numpy(np.float64))
    np.subtract.at(kinds, own["class"].to_numpy(np.int64), 1.0)
    unigram[SYMBOLS:END] = room
    share = np.log10(room + ADD * (kinds + 1))
    h = top["h"].to_numpy(np.int64)
    rows, rows_at = common.write_table(prepared(docs, Lookup(h[:SYMBOLS], np.arange(len(own))), Lookup(h, top["n"].to_numpy(np.float64))), "prepared")
    model = Hmm.begun(unigram)
    for _ in range(iterations if n_train else 0):
        model = iterate(rows.where("not held_out"), model)
    shared = spark.sparkContext.broadcast((model, share))

    def run(batches):
        model, share = shared.value
        for batch in common.slices(batches, "syms", 2 << 20):
            syms = _syms(batch)
            log = model.likelihoods(syms)
            within = np.array([share[s[(s >= SYMBOLS) & (s < END)].astype(np.int64) - SYMBOLS].sum() for s in syms])
            columns = ("key", "doc_id", "held_out", "n_tokens", "n_known", "all_log", "class_log")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(log - within)], names=[*columns, "log"])

    done = rows.select("key", "doc_id", "held_out", "n_tokens", "n_known", "all_log", "class_log", "syms").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, class_log double, log double")
    rare = rows.select("key", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("r")).select("key", F.col("r.rare_h").alias("h"), F.col("r.rare_n").alias("times"))
    rare = rare.join(counts.select("h", "n"), "h", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    end_log, norm = float(np.log10(n_train + ADD)), float(np.log10(n_all + ADD * (v_all + 1)))
    out = done.join(rare, "key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(n_train > 0)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("all_log") + rare_log + end_log - F.col("n_tokens") * norm).alias("base_score"), (F.col("log") + F.col("class_log") + rare_log).alias("score"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return scored(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_scores": op10_lm_scores}
