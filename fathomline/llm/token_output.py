"""Token ids of documents in a compressed file: canonical length-limited Huffman codes from global counts.

The file is a folder of two Parquet tables in the shared folder. `codebook` holds one row: code length of each id,
a byte each. `blocks` holds one row per block (part, block, n_docs, n_tokens, data); parts and blocks ascend with
doc_id, and each block can be decoded alone. A block, little-endian:

    magic 4s, version u16, interval u16, documents u32, groups u32, start u64 (ids before it in its part)
    null u8 each, doc_id i64 each, ids u64 each, bytes u64 each, bits of each group of `interval` ids u32 each
    the documents' bits, most significant first, each document from a whole byte on
    crc32 u32 of all the above

Steps: texts are tokenised once (table of ids, with the counts of each task's ids in a row of its own), the counts are
added up (a row for each id and task is shuffled), ids are shuffled by range of doc_id, 2 or 4 bytes each, and coded in
order. They aren't coded before the shuffle, as Spark takes its ranges from a pass over all that is to be shuffled, which
would code every document twice. The driver gets at most one row for each id of the vocabulary and for each part.

Null texts are empty; a document always has its end id. A null doc_id sorts first. Rows that repeat a doc_id are
documents of their own, in order of their ids' crc32. An empty table gives an empty file. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, huffman
from .pretoken import cache_of, load_json

MAGIC, VERSION = b"FLHT", 1
HEAD = struct.Struct("<4sHHIIQ")
#: Ids in a block, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 18


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids as little-endian bytes of 2 or 4 each, width, counts) of each whole text and its end id.

    Each task ends with a row that has counts (how often each id came, in order of id) and nothing else.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_json(tokenizer))  # a vocabulary: bounded
    schema = "doc_id long, ids binary, width int, counts array<long>"
    names = ["doc_id", "ids", "width", "counts"]

    def make():
        cache = cache_of(shared.value)
        end = np.array([end_id], cache.dtype).tobytes()
        width = cache.dtype().itemsize

        def run(batches):
            total = np.zeros(0, np.int64)
            for batch in common.slices(batches):
                ids = [cache.encode(t or "") + end for t in batch.column("text").to_pylist()]
                total = added(total, np.bincount(np.frombuffer(b"".join(ids), cache.dtype)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), width, np.int32)), pa.nulls(len(ids), pa.list_(pa.int64()))], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], names=names)

        return run

    return common.map_arrow(docs.select("doc_id", "text"), make, schema)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, how many each has)."""
    rows = batch.column("ids").to_pylist()
    width = batch.column("width")[0].as_py()
    return np.frombuffer(b"".join(rows), f"<u{width}"), np.array([len(r) // width for r in rows], np.int64)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts by id, of which one array may reach further than the other."""
    if len(a) < len(b):
        a, b = b, a
    a = a.astype(np.int64)
    a[: len(b)] += b
    return a


def count_ids(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tasks' counts; no ids are read."""
    each = ids.where("counts is not null").select(F.posexplode("counts").alias("id", "n")).where("n > 0")
    return each.groupBy("id").agg(F.sum("n").alias("n"))


def block_bytes(doc_ids: list, sizes: list[int], bits: list[bytes], groups: list[bytes], start: int) -> bytes:
    body = HEAD.pack(MAGIC, VERSION, huffman.INTERVAL, len(doc_ids), sum(map(len, groups)) // 4, start)
    body += bytes(x is None for x in doc_ids) + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + np.array([len(b) for b in bits], "<u8").tobytes() + b"".join(groups) + b"".join(bits)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes, decoder: huffman.Decoder) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(doc_ids, ids of each, all ids, start in its part)."""
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block's checksum doesn't hold")
    magic, version, interval, n, n_groups, start = HEAD.unpack_from(data)
    if (magic, version, interval) != (MAGIC, VERSION, huffman.INTERVAL):
        raise ValueError("not a block of this format")
    at = HEAD.size
    null = np.frombuffer(data, bool, n, at)
    doc_id, sizes, n_bytes = (np.frombuffer(data, t, n, at + n + 8 * n * k).astype(np.int64) for k, t in enumerate(("<i8", "<u8", "<u8")))
    at += 25 * n
    group_bits = np.frombuffer(data, "<u4", n_groups, at).astype(np.int64)
    ids = decoder.unpack(data[at + 4 * n_groups : -4], sizes, n_bytes, group_bits)
    return [None if z else d for z, d in zip(null.tolist(), doc_id.tolist(), strict=True)], sizes, ids, start


def assemble(ids: DataFrame, lengths: np.ndarray, parts: int) -> DataFrame:
    """(part, block, n_docs, n_tokens, data): documents coded, in blocks, in ascending order of doc_id."""
    schema = "part int, block int, n_docs long, n_tokens long, data binary"

    def make():
        codes = huffman.canonical(lengths)
        part = TaskContext.get().partitionId()

        def run(batches):
            rows, block, start = [[], [], [], []], 0, 0
            for batch in batches:
                for piece in common.slices([batch], "ids", 1 << 20):
                    for row in zip(piece.column("doc_id").to_pylist(), *coded(piece), strict=True):
                        for column, x in zip(rows, row, strict=True):
                            column.append(x)
                        if row[1] >= BLOCK_IDS or len(rows[1]) % 64 == 0 and sum(rows[1]) >= BLOCK_IDS:
                            yield out(rows, block, start)
                            block, start, rows = block + 1, start + sum(rows[1]), [[], [], [], []]
            if rows[0]:
                yield out(rows, block, start)

        def coded(batch):
            flat, sizes = _ids(batch)
            data, n_bytes, group_bits, groups = huffman.pack(flat, sizes, lengths, codes)
            return sizes.tolist(), common.split_binary(data, n_bytes).to_pylist(), common.split_binary(group_bits.astype("<u4").tobytes(), 4 * groups).to_pylist()

        def out(rows, block, start):
            data = block_bytes(rows[0], rows[1], rows[2], rows[3], start)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": pa.array([len(rows[0])], pa.int64()), "n_tokens": pa.array([sum(rows[1])], pa.int64()), "data": pa.array([data], pa.binary())})

        return run

    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids")]
    ordered = ids.where("width is not null").select("doc_id", "ids", "width").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.map_arrow(ordered, make, schema)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, limit: int = huffman.LIMIT) -> None:
    """Writes the ids of docs(doc_id, text) to the folder path. limit: bits of the longest code."""
    spark = docs.sparkSession
    ids, at = common.write_table(encode_documents(docs, tokenizer, end_id), "ids")
    counted = count_ids(ids).toPandas()  # a row for each id of the vocabulary at most
    counts = np.zeros(int(counted.id.max()) + 1 if len(counted) else 1, np.int64)
    counts[counted.id.to_numpy(np.int64)] = counted.n.to_numpy(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    assemble(ids, lengths, parts).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(pd.DataFrame({"lengths": [lengths.tobytes()]}), "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    common.delete(spark, at)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids as unsigned 32-bit little-endian bytes) of a written file; decoded only where read.

    with_ids=False leaves out the last column: all ids are decoded, but they don't travel to the JVM.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()["lengths"], np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each part
    offset, before = {}, 0
    for part, n in totals:
        offset[part], before = before, before + n

    def make():
        decoder = huffman.Decoder(lengths)

        def run(batches):
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    doc_id, sizes, ids, start = read_block(data, decoder)
                    ends = np.cumsum(sizes)
                    flat = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    out = {"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(offset[part] + start + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        out["ids"] = common.split_binary(flat, 4 * sizes)
                    yield pa.RecordBatch.from_pydict(out)

        return run

    return common.map_arrow(blocks.select("part", "data"), make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the file written and read again."""
    from public_tokenizers import path

    at = common.new_path(spark, "token-file")
    write_ids(common.table(spark, sf_dir, "documents"), at, path("byte_bpe_50k.json"))
    return read_ids(spark, at, with_ids=False)


QUERIES = {"op1_token_output": op1_token_output}
