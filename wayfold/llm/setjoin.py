"""N-gram Jaccard join: size-aware, with fixed-size subsets for light sets and inverted lists for heavy ones."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import WordTable, matching, row_key, scratch, sendable, table, text_of, written
from wayfold.llm.similar import components, mix, nodes_of, parity, set_hashes, shingle_sets, wide_parity

#: What a posting costs beside a subset's row where nothing was measured.
SCAN = 6.0
#: What comparing a posting with another set of its list costs beside a row.
COMPARE = 3.0
#: Shingles that are taken last because many documents have them, at most; found in FREQUENT_IN documents or more.
MOST_FREQUENT, FREQUENT_IN = 65_536, 32
#: Counters that a task holds while it counts, and rows of them that it gives.
TASK_COUNTERS, TASK_SUMMARY = 250_000, 4_096
#: One shingle in so many is counted exactly to measure inverted lists.
SLICE = 1_024


class Scheme:
    """Signatures such that any two sets with 100 * intersection >= percent * union share one.

    Light sets: linked sets of sizes n >= m have an intersection of at least percent * n / 100, so a set gives all of its
    subsets of these sizes; the intersection is one of them for both. Heavy sets: shingles have one order for all sets, and a
    set is put into the inverted lists of its first ones, one more than a linked set can lack; the first shingle that two
    linked sets share is among these of both. Any order gives all links: it is by hash, with the shingles of `frequent` (the
    most frequent last) after the others, so that lists are short. The boundary is the largest size whose subsets cost no
    more than its postings, each of which counts `scan`. A light set that a heavy one can be linked to gives both.
    """

    def __init__(self, percent: int, scan: float = SCAN, frequent: np.ndarray | None = None):
        self.percent, self.light = percent, 0
        frequent = np.zeros(0, np.uint64) if frequent is None else frequent
        order = np.argsort(frequent, kind="stable")
        self.sorted, self.rank = frequent[order], order.astype(np.int64)
        while self.light < 200 and self.subsets(self.light + 1) <= scan * self.prefix(self.light + 1):
            self.light += 1

    def lost(self, n: int) -> int:
        """Elements of a set of n that a linked set can lack."""
        return n - -(-self.percent * n // 100)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, d) for d in range(self.lost(n) + 1))

    def prefix(self, n: int) -> int:
        return self.lost(n) + 1

    def first(self, s: np.ndarray) -> np.ndarray:
        """The shingles of a sorted set that come first in the order of all sets."""
        p = self.prefix(len(s))
        if not len(self.sorted):
            return s[:p]
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        often = self.sorted[at] == s
        rare = s[~often][:p]
        if len(rare) == p:
            return rare
        rest = s[often]
        return np.r_[rare, rest[np.argsort(self.rank[at[often]])][: p - len(rare)]]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        if n == 0:
            return s
        larger = 100 * n // self.percent  # the most that a linked set can have
        if larger == n and not self.lost(n):
            return s[:0]
        with np.errstate(over="ignore"):
            if n <= self.light:
                m = mix(s)
                total = m.sum()
                for d in range(self.lost(n) + 1):
                    gone = m[np.array(list(itertools.combinations(range(n), d)), np.int64).reshape(-1, d)].sum(1, dtype=np.uint64) if d else np.zeros(1, np.uint64)
                    out.append(mix(total - gone + np.uint64(n - d) * np.uint64(0xD6E8FEB86659FD93)))
            if larger > self.light:
                out.append(mix(self.first(s) ^ np.uint64(0xA0761D6478BD642F)))
        return np.concatenate(out) if out else s[:0]


def shingle_statistics(rows: DataFrame, size: int, percent: int) -> tuple[np.ndarray, float]:
    """From all texts of `rows` (doc_id, text): the shingles that many documents have, the most frequent last, and the mean length of the inverted list that a posting of any other is in.

    Tasks give summaries of bounded size (Misra-Gries: what is frequent survives) of the shingles that a prefix by hash can
    hold, and exact counts of a slice of all shingles by hash, a share of 1 / SLICE. Both only choose the order and the
    boundary of a Scheme, which finds all links under any.
    """
    below = np.uint64(min(1.0, 1.5 * (1 - percent / 100) + 0.05) * float(1 << 64) * (1 - 1e-9))

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return values, np.bincount(index, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)

    def summarise(batches):
        known = word_table()
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        low, part, waiting = [none], [none], 0
        for b in batches:
            lists = [*map(words_of, b.column(1).to_pylist())]
            known.learn(lists)
            flat = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(lists, known, size)])
            some, exact = flat[flat < below], flat[mix(flat) % np.uint64(SLICE) == 0]
            low.append((some, np.ones(len(some), np.int64)))
            part.append((exact, np.ones(len(exact), np.int64)))
            waiting += len(some)
            if waiting > 8 * TASK_COUNTERS:
                values, counts = added(low)
                if len(values) > TASK_COUNTERS:
                    counts = counts - np.partition(counts, -TASK_COUNTERS // 4)[-TASK_COUNTERS // 4]
                    values, counts = values[counts > 0], counts[counts > 0]
                low, part, waiting = [(values, counts)], [added(part)], 0
        (values, counts), exact = added(low), added(part)
        top = np.argsort(-counts, kind="stable")[:TASK_SUMMARY]
        top = top[counts[top] > 1]
        flat, n = np.r_[values[top], exact[0]], np.r_[counts[top], exact[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) < len(top)), pa.array(flat.view(np.int64)), pa.array(n)], ["top", "e", "n"])

    with scratch(rows.sparkSession):
        counted = written(rows.mapInArrow(summarise, "top boolean, e long, n long").groupBy("top", "e").agg(F.sum("n").alias("n")), "shingle-counts")
        often = counted.where(F.col("top") & (F.col("n") >= FREQUENT_IN)).orderBy(F.desc("n"), "e").limit(MOST_FREQUENT).select("e").toArrow()
        sums = counted.where(~F.col("top") & (F.col("n") < FREQUENT_IN)).agg(F.sum(F.col("n") * F.col("n")).alias("square"), F.sum("n").alias("n")).first()
    return np.ascontiguousarray(often.column("e").to_numpy()[::-1]).view(np.uint64), (sums.square / sums.n if sums.n else 1.0)


def word_table() -> WordTable:
    return WordTable(xxhash.xxh3_64_intdigest)


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and 09 to 0D, A-Z lower-cased."""
    return text.encode().lower().split()


def ngram_join(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id.

    A document's set is its distinct shingles of `size` words; with fewer words the whole sequence is one, without words or
    text the set is empty and linked with nothing. Two documents are linked if 100 * intersection >= percent * union;
    component_id is the least doc_id that links lead to. The result is exact but for collisions of 64-bit word and shingle
    hashes. Rows with one doc_id and different texts are compared each for itself; rows with a null doc_id are linked with
    nothing and have a null component_id. Other columns are left out; an empty table gives none.
    """
    rows = text_of(docs, "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    frequent, length = shingle_statistics(rows, size, percent)
    sent = docs.sparkSession.sparkContext.broadcast(Scheme(percent, 1 + COMPARE * max(0.0, length - 1), frequent))

    def shingle(batches):
        scheme = sent.value
        known = word_table()
        for b in batches:
            lists = [*map(words_of, b.column(1).to_pylist())]
            known.learn(lists)
            sets = [*shingle_sets(lists, known, size)]
            hashes = [set_hashes(s) for s in sets]
            seen: set[int] = set()  # equal sets of a batch give their signatures once
            sigs = [scheme.signatures(s if h not in seen and not seen.add(h) else s[:0]).view(np.int64) for s, (h, _) in zip(sets, hashes, strict=True)]
            ends = np.r_[0, np.cumsum([len(x) for x in sigs])].astype(np.int32)
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64), pa.int64())
            longs = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [h for h, _ in hashes], [h for _, h in hashes])]
            p, w = (pa.array([f(s).tobytes() for s in sets], pa.binary()) for f in (parity, wide_parity))
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.ListArray.from_arrays(pa.array(ends), flat), p, w], ["doc_id", "n_shingles", "h", "h2", "sigs", "p", "w"])

    made = written(rows.mapInArrow(shingle, f"doc_id {kind}, n_shingles long, h long, h2 long, sigs array<long>, p binary, w binary"), "shingles")
    some = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = nodes_of(some, "doc_id")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Made again from the text of one document of each node: the sets of all documents are never stored."""
        ids = written(nodes.join(wanted, "h", "left_semi").select("h", F.col("first.doc_id").alias("doc_id")), "wanted")

        def again(batches):
            known = word_table()
            for b in batches:
                lists = [*map(words_of, b.column(1).to_pylist())]
                known.learn(lists)
                sets = [*shingle_sets(lists, known, size)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_hashes(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["wanted", "h", "s"])

        return matching(rows, ids, "doc_id").select("h", "text").mapInArrow(again, "wanted long, h long, s binary").where("wanted = h").select("h", "s").dropDuplicates(["h"])

    comps = components(some.select(F.explode("sigs").alias("sig"), "h"), sets_of, percent, some.select("h", F.col("n_shingles").cast("int").alias("n"), "p", "w"))
    named = nodes.select("h", F.col("first.doc_id").alias("least")).join(comps, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "comp").select("h", "component_id")
    full = some.select("doc_id", "n_shingles", "h").join(labels, "h").select("doc_id", "n_shingles", "component_id")
    return full.union(made.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ngram_join` of all documents at its defaults."""
    return ngram_join(table(spark, sf_dir, "documents"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked rows the one with the least doc_id stays, rows without a doc_id coming last.

    Linked are rows with a similarity of 0.8 in shingles of five words, unlike in the query op9_ngram_join.
    Rows are told apart by doc_id and text, so a row goes only if its own text is linked; of rows equal in both one stays.
    Texts without words are linked with nothing, and all of them stay. Columns of any name are kept; an empty table gives none.
    """
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names inside can't clash with the table's
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = numbered.withColumn("row", row_key(at["doc_id"], at["text"]))
    with scratch(spark) as keep:
        groups = ngram_join(rows.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text")), percent=80, size=5)
        each = groups.groupBy(F.col("doc_id").alias("row")).agg(F.count("*").alias("n"), (F.max("n_shingles") > 0).alias("words"), F.min("component_id").alias("least"))
        each = written(each.where("row <> least OR (words AND n > 1)"), "grouped")
        gone, twice = (keep(written(each.where(f).select("row"), "rows")) for f in ("row <> least", "row = least"))
    rest = rows.join(sendable(gone), "row", "left_anti")
    one = rest.join(sendable(twice), "row", "left_semi").dropDuplicates(["row"])
    out = rest.join(sendable(twice), "row", "left_anti").unionByName(one)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.c)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.sh
"""
