"""Quality: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import ChunkTable, chunks_of, held_out, table, text_of
from wayfold.llm.labelled import labelled_sample

WORDS, SHAPES, WHOLE = 1 << 14, 1 << 9, 5
SIZE = WORDS + SHAPES + WHOLE
#: Labelled documents that the regression is fitted on, at most.
MOST_LABELLED = 1_500

_MARKS = re.compile(r"([^\w\s])\1*")


def slots(chunk: str) -> tuple[int, int]:
    """Hashed word and hashed shape of a chunk: letters by case, digits, and its marks themselves."""
    word = "".join(filter(str.isalnum, chunk)).lower()
    head = "A" if chunk.isupper() else "a" if chunk.islower() else "Aa" if chunk[:1].isupper() else "x"
    shape = head + "0" * any(map(str.isdigit, chunk)) + "".join(sorted(set(_MARKS.findall(chunk)))) + ("+" if len(word) > 12 else "")
    return zlib.crc32(word.encode()) % WORDS, WORDS + zlib.crc32(shape.encode()) % SHAPES


def whole(chunks: list[str]) -> list[float]:
    """What is known of a text as a whole: next to each other repeated, distinct and repeated chunks, length, emptiness."""
    n = len(chunks)
    if not n:
        return [0.0, 0.0, 0.0, 0.0, 1.0]
    return [sum(map(eq, chunks, chunks[1:])) / n, len(set(chunks)) / n, len(set(chunks)) / n**0.85, np.log1p(n) / 10, 0.0]


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(weights . features - cuts[k-1]); cuts rise, so the chances fall with k."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts[None, :], -40, 40)))


def fit_ordinal(rows: list[tuple[int, list[int], list[float]]], grades: int, steps: int = 100, rate: float = 0.2, ridge: float = 1e-5) -> Ordinal:
    """Maximum likelihood by Adam over (grade, slots, values). Cuts are the first cut and the logs of the steps between them."""
    weights, steps_log, first = np.zeros(SIZE), np.zeros(max(0, grades - 2)), 0.0
    if rows:
        y = np.array([r[0] for r in rows])
        idx, val = np.concatenate([np.array(r[1]) for r in rows]), np.concatenate([np.array(r[2], float) for r in rows])
        edge = np.r_[0, np.cumsum([len(r[1]) for r in rows])[:-1]]
        owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        theta = np.r_[weights, first, steps_log]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        k = np.arange(grades - 1)
        for t in range(1, steps + 1):
            w, gaps = theta[:SIZE], np.exp(theta[SIZE + 1 :])
            cuts = theta[SIZE] + np.r_[0, np.cumsum(gaps)]
            s = np.add.reduceat(val * w[idx], edge)
            up = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))  # P(y >= k + 1)
            tail = np.c_[np.ones(len(y)), up, np.zeros(len(y))]
            mass = np.maximum(np.take_along_axis(tail, y[:, None], 1) - np.take_along_axis(tail, y[:, None] + 1, 1), 1e-9)
            slope = up * (1 - up)
            by_cut = ((y[:, None] == k + 1).astype(float) - (y[:, None] == k)) * slope / mass  # d log P / d(s - cut k)
            g_s, g_cut = by_cut.sum(1) / len(y), -by_cut.sum(0) / len(y)
            g = np.r_[np.bincount(idx, val * g_s[owner], SIZE) - ridge * w, g_cut.sum(), [g_cut[j + 1 :].sum() * gaps[j] for j in range(grades - 2)]]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, first, steps_log = theta[:SIZE], theta[SIZE], theta[SIZE + 1 :]
    return Ordinal(weights, first + np.r_[0, np.cumsum(np.exp(steps_log))])


def features(text: str, known: ChunkTable) -> tuple[list[int], list[float]]:
    chunks = [c for c in chunks_of(text) if c]
    known.learn([chunks])
    counts: Counter = Counter()
    for c, n in Counter(chunks).items():
        for slot in known[c]:
            counts[slot] += n
    return [*counts, *range(SIZE - WHOLE, SIZE)], [*(v / len(chunks) for v in counts.values()), *whole(chunks)]


def train(docs: DataFrame, ratings: DataFrame, grades: int, most: int = MOST_LABELLED) -> Ordinal:
    """Fits on at most `most` rated documents (doc_id, grade 0 to `grades` - 1) that are not held out."""

    def sparse(batches):
        known = ChunkTable(lambda new: map(slots, new))
        for b in batches:
            found = [features(t, known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["doc_id", "grade", "idx", "val"]
            )

    chosen = labelled_sample(docs, ratings, F.col("grade"), most).where(F.col("grade").between(0, grades - 1))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(sparse, f"doc_id {kind}, grade int, idx array<int>, val array<double>").orderBy("doc_id").collect()
    return fit_ordinal([(r.grade, r.idx, r.val) for r in rows], grades)


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Per row: doc_id, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...).

    Null and empty texts have only the mark of emptiness as a feature. Every row gives one row, ties and repeats included;
    other columns are left out; an empty table gives none; whole texts count.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = text_of(docs, "doc_id")

    def score(batches):
        own = sent.value
        known = ChunkTable(lambda new: [own.weights[a] + own.weights[b] for a, b in map(slots, new)])
        last = own.weights[-WHOLE:]
        for b in batches:
            lists = [[c for c in chunks_of(t) if c] for t in b.column(1).to_pylist()]
            known.learn(lists)
            s = np.array([sum(map(known.__getitem__, x)) / max(1, len(x)) + float(last @ np.array(whole(x))) for x in lists])
            tails = own.tails(s) if len(s) else np.zeros((0, len(own.cuts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1), pa.float64()), pa.array(tails.tolist(), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, expected_grade double, tails array<double>")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grades from the labels: 0 poor, 1 good but toxic, 2 good. Documents are selected whose chance of grade 1 or more is at least a half."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))
    graded = grade(docs, train(docs, ratings, 3))
    return graded.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_best"), (F.col("tails")[0] >= 0.5).alias("selected")
    )
