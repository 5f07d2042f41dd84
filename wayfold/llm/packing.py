"""Packing along a space-filling curve: documents near each other on it share sequences."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import ChunkTable, scratch, shuffle_partitions, table, text_of, written
from wayfold.llm.tokens import encoder

SLOTS, DIMS, BITS = 256, 3, 10
#: Chunks whose ids a worker keeps.
CHUNKS_KEPT = 700_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= q - 1
            t = (x[:, 0] ^ x[:, i]) & (q - 1)
            t[on] = 0
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, n - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def projection(slots: int = SLOTS, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (slots, dims))


def curve_keys(ids: np.ndarray, sizes: np.ndarray, plane: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents by their token ids, joined, `sizes` of each: counts hashed to slots, scaled to length one, projected, cut to a grid."""
    slot = ((ids.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(11)) % np.uint64(len(plane))).astype(np.int64)
    v = np.bincount(slot + np.repeat(np.arange(len(sizes)) * len(plane), sizes), minlength=len(sizes) * len(plane)).reshape(len(sizes), len(plane))
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    flat = v @ plane
    grid = np.clip(((np.tanh(flat) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert_key(grid, bits)


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs all documents into sequences of `length` tokens along the curve; only the last sequence is padded.

    Rows, one a piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.
    A document's ids are those of its text (null: empty) and `end_id`, so each gives a piece at least. Documents are range-sorted
    by (key, doc_id), so a key that many share is dealt over partitions; running totals within and over partitions place each
    document in one long row of tokens, cut every `length`. Equal or null doc_ids are separate documents; very long ones span
    many sequences; other columns are left out; an empty table gives none.
    """
    spark = docs.sparkSession
    unit = encoder(path).unit
    rows = text_of(docs, "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        own = encoder(path)
        known = ChunkTable(own.encode, {"": b""}, CHUNKS_KEPT)
        plane, end = projection(), np.array([end_id], unit).tobytes()
        for b in batches:
            lists = [*map(own.chunks, b.column(1).to_pylist())]
            known.learn(lists)
            ids = [b"".join(map(known.__getitem__, x)) + end for x in lists]
            sizes = np.array([len(x) // unit.itemsize for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), unit)
            rest = np.ones(len(flat), bool)
            rest[np.cumsum(sizes) - 1] = False
            keys = curve_keys(flat[rest], sizes - 1, plane)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(sizes), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])

    def run_on(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(2).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(ends - n, pa.int64()), b.column(2), b.column(3)], ["doc_id", "part", "at", "n", "ids"])
            at = int(ends[-1]) if len(n) else at

    with scratch(spark) as keep:
        keyed = written(rows.mapInArrow(encode, f"doc_id {kind}, key long, n long, ids binary"), "pack-ids", "zstd")
        dealt = keyed.repartitionByRange(shuffle_partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id")
        placed = keep(written(dealt.mapInArrow(run_on, f"doc_id {kind}, part int, at long, n long, ids binary"), "pack-placed"))
    totals = {r.part: r.n for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for p in sorted(totals):
        before[p], total = total, total + totals[p]
    sent = spark.sparkContext.broadcast(before)

    def cut(batches):
        for b in batches:
            docs_, starts, lengths, crcs, sizes, seqs, offs = [], [], [], [], [], [], []
            for d, part, at, n, ids in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                at += sent.value[part]
                own = np.frombuffer(ids, unit).astype("<u4")
                a = 0
                while a < n:
                    size = min(n - a, length - (at + a) % length)
                    docs_.append(d)
                    starts.append(a)
                    lengths.append(size)
                    crcs.append(zlib.crc32(own[a : a + size].tobytes()))
                    sizes.append(n)
                    seqs.append((at + a) // length)
                    offs.append((at + a) % length)
                    a += size
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, sizes, seqs, offs)]
            yield pa.RecordBatch.from_arrays([pa.array(docs_, b.column(0).type), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack` of all documents at its defaults."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that were kept, as `pack` gives them; null and empty texts, equal and null ids, repeated rows and empty tables as there."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
