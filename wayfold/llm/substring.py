"""Substring dedup: paragraphs that repeat, found by MinHash banding, verified exactly, removed by components."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WordTable, matching, row_key, scratch, sendable, table, text_of, written
from wayfold.llm.setjoin import word_table, words_of
from wayfold.llm.similar import components, mix, one_hash_each, shingle_hashes


try:
    from _md5 import md5 as _MD5  # less to set up than OpenSSL's, which counts for words
except ImportError:
    _MD5 = hashlib.md5

#: Words on either side among which a word's hash is least where a line is cut.
NEAR = 8


def cuts(words: np.ndarray, lines: np.ndarray, near: int = NEAR) -> np.ndarray:
    """True for the words that end a piece: the last of each line, and those whose hash is the least (of equal ones the first)
    among `near` words on either side in the line. A passage is so cut at the same places wherever it stands."""
    n = len(words)
    out = np.zeros(n, bool)
    if n > 2 * near:
        mid = words[near : n - near]
        own = lines[2 * near :] == lines[: n - 2 * near]
        for k in range(1, near + 1):
            own &= (mid < words[near - k : n - near - k]) & (mid <= words[near + k : n - near + k])
        out[near : n - near] = own
    if n:
        out[-1] = True
        out[:-1] |= lines[1:] != lines[:-1]
    return out


def bands_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's least hashes are bands: one more than the elements that an alike set can lack, so that two alike sets share a band always (recall 1). None where only an equal set is alike."""
    lost = sizes - -(-percent * sizes // 100)
    return np.where((lost == 0) & (100 * sizes // percent == sizes), 0, lost + 1)


def word_codes() -> WordTable:
    """word -> the first half of its MD5, which SQL has too."""
    md5, number = _MD5, int.from_bytes
    return WordTable(lambda w: number(md5(w).digest()[:8]))


def in_order(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order by (group, h); groups are numbered in order, so those of 16 bits need no comparisons."""
    if not len(group) or group[-1] >= 1 << 16:
        return np.lexsort((h, group))
    order = np.argsort(h)
    return order[np.argsort(group[order].astype(np.uint16), kind="stable")]


@dataclass
class Pieces:
    """The pieces of at least `size` words of a batch of texts, in order: owner (number of the text), word (number of its first word there), words, and the sorted distinct hashes of their shingles, `sizes` of each."""

    owner: np.ndarray
    word: np.ndarray
    words: np.ndarray
    shingles: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: list[str], known: WordTable, size: int, near: int = NEAR) -> Pieces:
        known.learn()
        cut = [t.encode().lower().split(b"\n") for t in texts]
        lines = [x.split() for t in cut for x in t]
        of_line = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(lines)), np.uint64, int(of_line.sum()))
        of_text = np.cumsum([0, *map(len, cut)])[:-1]
        lengths = np.add.reduceat(of_line, of_text) if len(cut) else of_line
        line = np.repeat(np.arange(len(of_line)), of_line)
        ends = np.flatnonzero(cuts(flat, line, near))
        starts = np.r_[0, ends + 1][:-1]
        words = ends - starts + 1
        text = np.repeat(np.arange(len(texts)), lengths)[starts] if len(flat) else starts
        keep = words >= size
        piece = np.repeat(np.arange(len(starts)), words)
        h = shingle_hashes(flat, size)
        inner = (piece[: len(h)] == piece[size - 1 :][: len(h)]) if len(h) else np.zeros(0, bool)
        h, piece = h[inner], piece[: len(h)][inner]
        order = in_order(h, piece)
        h, piece = h[order], piece[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (piece[1:] != piece[:-1])][: len(h)]
        h, piece = h[first], piece[first]
        before = np.r_[0, np.cumsum(lengths)]
        return Pieces(text[keep], (starts - before[text])[keep], words[keep], h, np.bincount(piece, minlength=len(starts))[keep] if len(starts) else starts)

    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.sizes)][:-1]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each piece's set."""
        if not len(self.sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            each = (np.add.reduceat(mix(self.shingles ^ x), self.starts()) + self.sizes.astype(np.uint64) for x in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)))
            return tuple(mix(x).view(np.int64) for x in each)

    def bands(self, percent: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands of the pieces `which`, and how many each piece has."""
        n = np.where(which, bands_of(self.sizes, percent), 0)
        at = np.arange(len(self.shingles)) - np.repeat(self.starts(), self.sizes)
        return self.shingles[at < np.repeat(n, self.sizes)].view(np.int64), n


def _alike(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc_id, para, word, words, comp) of the paragraphs that have a like one."""
    rows = text_of(docs, "doc_id").where("doc_id IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        known = word_codes()
        for b in batches:
            p = Pieces.of(b.column(1).to_pylist(), known, size)
            h, h2 = p.hashes()
            _, own = np.unique(h, return_index=True)  # equal pieces of a batch give their bands once
            which = np.zeros(len(h), bool)
            which[own] = True
            flat, n = p.bands(percent, which)
            first = np.r_[True, p.owner[1:] != p.owner[:-1]] if len(h) else which
            number = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) if len(h) else h
            ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            ints = [pa.array(x.astype(np.int32)) for x in (number, p.word, p.words)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(p.owner)), *ints, pa.array(h), pa.array((h2 & 0x7FFFFFFF).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))],
                ["doc_id", "para", "word", "words", "h", "h2", "sigs"],
            )

    made = written(rows.mapInArrow(cut, f"doc_id {kind}, para int, word int, words int, h long, h2 int, sigs array<long>"), "paragraphs", "zstd")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Made again from the text of one document of each node: the sets of all paragraphs are never stored."""
        some = made.select("doc_id", "h").join(sendable(written(wanted, "wanted")), "h", "left_semi")
        ids = some.groupBy("h").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
        ids = written(ids, "wanted-of")

        def again(batches):
            known = word_codes()
            for b in batches:
                p = Pieces.of(b.column(1).to_pylist(), known, size)
                h, starts = p.hashes()[0], p.starts()
                wanted = [set(x) for x in b.column(0).to_pylist()]
                out = {int(x): p.shingles[a : a + n].tobytes() for x, o, a, n in zip(h, p.owner, starts, p.sizes, strict=True) if int(x) in wanted[o]}
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["h", "s"])

        return matching(rows, ids, "doc_id").select("hs", "text").mapInArrow(again, "h long, s binary").dropDuplicates(["h"])

    comps = components(made.select(F.explode("sigs").alias("sig"), "h"), sets_of, percent)
    seen = written(made.groupBy("h").agg(F.count("*").alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("n > 1 OR lo <> hi"), "repeated")
    one_hash_each(seen, "lo <> hi")
    nodes = written(seen.select("h").join(comps, "h", "full").select("h", F.coalesce("comp", "h").alias("comp")), "nodes")
    return written(made.select("doc_id", "para", "word", "words", "h").join(nodes, "h").drop("h"), "marked", "zstd")


def repeated_paragraphs(docs: DataFrame, percent: int = 80, size: int = 5, least_words: int = 30) -> DataFrame:
    """The paragraphs that stand elsewhere too, within a document or over all, where they make up a passage of at least `least_words` words.

    Paragraphs are the pieces into which content cuts the lines of a text (`cuts`): a short line is one, a longer one several,
    and a copied passage gives the same pieces inside any line. Pieces under `size` words have no shingle and are left out.
    Two link if the Jaccard similarity of their `size`-word shingles is percent / 100 or more; MinHash bands (the least hashes
    of one permutation, as many as the size needs for a recall of 1) find the pairs, exact sets verify them, and linked ones
    are one component. A passage is a run of paragraphs next to each other that each have a like one somewhere.

    Rows: doc_id, para (number of the paragraph in its document), word and words (its first word and its length, in words of
    `words_of`), passage_words (of its run), kept_doc_id and kept_para (the first paragraph of its component by doc_id and number),
    kept (whether it is that one). Null and empty texts have no paragraphs; paragraphs equal in their shingles are one node, however many; rows with a
    null doc_id are left out; rows with one doc_id are documents of one name, so all but the least of their equal paragraphs
    are repeats; other columns are left out; an empty table gives none. Whole texts count, however long.
    """
    with scratch(docs.sparkSession) as keep:
        full = keep(_alike(docs, percent, size))
    kept = full.groupBy("comp").agg(F.min(F.struct("doc_id", "para")).alias("first"))
    # runs of paragraphs with consecutive numbers; equal rows share a rank
    order = Window.partitionBy("doc_id").orderBy("para")
    run = full.withColumn("run", F.col("para") - F.dense_rank().over(order))
    whole = Window.partitionBy("doc_id", "run")
    run = run.withColumn("passage_words", F.max(F.col("word") + F.col("words")).over(whole) - F.min("word").over(whole)).where(F.col("passage_words") >= least_words)
    out = run.join(kept, "comp").select("doc_id", "para", "word", "words", "passage_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.para").alias("kept_para"))
    return out.withColumn("kept", (F.col("doc_id") == F.col("kept_doc_id")) & (F.col("para") == F.col("kept_para")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`repeated_paragraphs` of all documents at its defaults."""
    return repeated_paragraphs(table(spark, sf_dir, "documents"))


#: Words of the runs that fingerprints are taken of.
GRAM = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes, in constant time a run."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - 1, _BASE, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _UNBASE, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(mix(words) * up)]
        return mix((sums[size:] - sums[:-size]) * down)


def picked(hashes: np.ndarray, among: int) -> np.ndarray:
    """Places of the least of each `among` neighbouring hashes (ties: the last), so equal stretches of so many have one picked at the same place."""
    if len(hashes) < among:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, among)
    return np.unique(np.arange(len(views)) + among - 1 - views[:, ::-1].argmin(1))


def repeated_passages(docs: DataFrame, run: int = 50) -> DataFrame:
    """The passages that stand elsewhere too, in a document or over all: doc_id, word (number of the first), words (how many).

    Every run of `run` words (of `words_of`, over line ends too) that occurs again is found, exactly but for collisions of
    64-bit hashes. The occurrence first by doc_id and place stays whole; of the others, the words that no such first
    occurrence covers are given. No pairs are made: fingerprints picked by content narrow the search to runs around those
    that occur twice, which are then grouped by hash. Rows with a null doc_id are left out. Runs that differ in a word
    are not repeats here.
    """
    rows = text_of(docs, "doc_id").where("doc_id IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    among = run - GRAM + 1

    def hashed(known, texts):
        lists = [*map(words_of, texts)]
        known.learn(lists)
        return [np.fromiter(map(known.__getitem__, x), np.uint64, len(x)) for x in lists]

    def listed(ids, places, hashes):
        ends = pa.array(np.r_[0, np.cumsum([len(x) for x in places])].astype(np.int32))
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, hashes)]
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(flat[0], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(flat[1], pa.int64()))], ["doc_id", "at", "h"])

    def fingerprints(batches):
        known = word_table()
        for b in batches:
            grams = [run_hashes(w, GRAM) for w in hashed(known, b.column(1).to_pylist())]
            places = [picked(g, among) for g in grams]
            yield listed(b.column(0), places, [g[p].view(np.int64) for g, p in zip(grams, places, strict=True)])

    def runs(batches):
        known = word_table()
        for b in batches:
            places, hashes = [], []
            for w, at in zip(hashed(known, b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                h = run_hashes(w, run)
                near = np.unique((np.array(at, np.int64)[:, None] - np.arange(among)).ravel())
                places.append(near := near[(near >= 0) & (near < len(h))])
                hashes.append(h[near].view(np.int64))
            yield listed(b.column(0), places, hashes)

    def merged(batches):
        for b in batches:
            ids, starts, sizes = [], [], []
            for k, marks in enumerate(b.column(1).to_pylist()):
                cover = np.zeros(max(m["at"] for m in marks) + run + 1, np.int8)
                for first in (False, True):
                    for m in marks:
                        if m["first"] == first:
                            cover[m["at"] : m["at"] + run] = not first
                edges = np.diff(np.r_[np.int8(0), cover])
                own = np.flatnonzero(edges == 1)
                ids += [k] * len(own)
                starts += own.tolist()
                sizes += (np.flatnonzero(edges == -1) - own).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], ["doc_id", "word", "words"])

    def exploded(df):
        return df.select("doc_id", F.explode(F.arrays_zip("at", "h")).alias("e")).select("doc_id", "e.at", "e.h")

    schema = f"doc_id {kind}, at array<int>, h array<long>"
    prints = exploded(written(rows.mapInArrow(fingerprints, schema), "fingerprints", "zstd"))
    twice = prints.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    near = written(prints.join(twice, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("at")), "near")
    found = exploded(written(matching(rows, near, "doc_id").select("doc_id", "text", "at").mapInArrow(runs, schema), "runs", "zstd"))
    first = found.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("one"), F.count("*").alias("n")).where("n > 1")
    marks = found.join(first, "h").select("doc_id", F.struct("at", (F.struct("doc_id", "at") == F.col("one")).alias("first")).alias("m"))
    return marks.groupBy("doc_id").agg(F.collect_list("m").alias("marks")).mapInArrow(merged, f"doc_id {kind}, word int, words int")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these runs of words (word, words). Line ends around them stay, but for that of a line which is one such run."""
    words, out, at = [m.span() for m in _WORD.finditer(text)], "", 0
    for word, n in sorted(spans):
        start, end = words[word][0], words[word + n - 1][1]
        out += text[at:start]
        at = end
        if not out or out[-1] in " \n":
            at += len(text[at:]) - len(text[at:].lstrip(" "))
        if out[-1:] in ("", "\n") and "\n" not in text[start:end] and text[at : at + 1] in ("", "\n"):
            out, at = (out, at + 1) if at < len(text) else (out[:-1], at)
    return out + text[at:]


#: Words of a passage that is cut out of a line of which the rest stays.
PASSAGE = 50


def without_paragraphs(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without its repeats (word, words, passage_words): lines of which they are four fifths or more go whole, of other lines passages of PASSAGE words or more."""
    size_of, at, out = {w: size for word, n, size in spans for w in range(word, word + n)}, 0, []
    for line in text.split("\n"):
        own = [size_of.get(k) for k in range(at, at + len(_WORD.findall(line)))]
        at += len(own)
        if not own or 5 * sum(x is not None for x in own) < 4 * len(own):
            cut = [(k, 1) for k, size in enumerate(own) if (size or 0) >= PASSAGE]
            out.append(without_words(line, cut) if cut else line)
    return "\n".join(out)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeats are cut out of the texts; a document of which only blanks are left goes. n_chars, where there is one, follows the text.

    First passages of 50 words or more that stand elsewhere word for word go, within lines or over several, then repeated
    paragraphs (of five words, a shingle, or more) that are not the first of their component: lines that are nothing else, and
    what makes up a passage of 50 words or more. Rows are told apart by doc_id and text, so rows of one doc_id are decided each
    for itself, and those without a doc_id too; rows equal in both get the same text. Null and empty texts stay as they are.
    Columns of any name are kept; an empty table gives none.
    """
    n = len(docs.columns)
    numbered = docs.toDF(*(f"c{k}" for k in range(n)))  # names inside can't clash with the table's
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    text = at["text"]

    def without(df: DataFrame, spans: DataFrame, take: Callable[[str, list], str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`df` with the words of `spans` (doc_id: a row's key, then what `take` is given) taken out, and `changed` set there."""
        each = spans.groupBy(F.col("doc_id").alias("row")).agg(F.sort_array(F.collect_set(F.struct(*spans.columns[1:]))).alias("spans"))
        each = keep(written(each, "spans"))
        shortened = F.udf(lambda text, spans: take(text, [tuple(s) for s in spans]), "string")
        new = matching(df, each, "row").withColumn(text, shortened(text, "spans")).withColumn("changed", F.lit(True)).drop("row", "spans")
        return new.unionByName(df.join(sendable(each.select("row")), "row", "left_anti").drop("row"))

    key, of_rows = row_key(at["doc_id"], text), lambda df: df.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))
    rows = numbered.withColumn("changed", F.lit(False)).withColumn("row", key)
    with scratch(spark) as keep:
        rows = keep(written(without(rows, repeated_passages(of_rows(rows)), without_words, lambda df: df), "passages-cut", "zstd"))
    rows = rows.withColumn("row", key)
    with scratch(spark) as keep:
        repeats = repeated_paragraphs(of_rows(rows), least_words=5).where("NOT kept").select("doc_id", "word", "words", "passage_words")
        out = without(rows, repeats, without_paragraphs, keep)
    out = out.where(f"NOT changed OR {text} RLIKE '[^ \\\\t\\\\r\\\\n]'")
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.col("changed"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


OP8_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
v AS (SELECT doc_id, line, [x FOR x IN string_split_regex(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM l),
w AS (SELECT doc_id, line, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM v WHERE len(ws) > 0),
m AS (SELECT *, left(md5(w), 16) AS m FROM w),
c AS (SELECT *, i = n - 1 OR (i >= 8 AND i < n - 8 AND m < min(m) OVER b AND m <= min(m) OVER a) AS cut FROM m
  WINDOW b AS (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)),
g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY line, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) - 1 AS word FROM c),
q AS (SELECT doc_id, min(word) AS word, count(*) AS words, list(w ORDER BY word) AS ws FROM g GROUP BY doc_id, piece HAVING count(*) >= 5),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word) - 1 AS para FROM q),
s AS (SELECT doc_id * 100000 + para AS id, doc_id, para, word, words, list_sort(list_distinct([array_to_string(ws[k:k + 4], ' ') FOR k IN range(1, len(ws) - 3)])) AS sh FROM t),
d AS (SELECT min(id) AS node, count(*) AS times, sh, len(sh) AS n FROM s GROUP BY sh),
e AS (SELECT node, n, unnest(sh) AS x FROM d),
k AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(node, c) AS (SELECT node, node FROM d WHERE node IN (SELECT a FROM k) UNION SELECT r.node, k.b FROM r JOIN k ON k.a = r.c),
y AS (SELECT d.sh, least(d.node, coalesce(min(r.c), d.node)) AS kept FROM d LEFT JOIN r USING (node) WHERE d.times > 1 OR r.node IS NOT NULL GROUP BY d.sh, d.node),
z AS (SELECT s.*, kept, para - row_number() OVER (PARTITION BY doc_id ORDER BY para) AS run FROM s JOIN y USING (sh)),
f AS (SELECT *, max(word + words) OVER (PARTITION BY doc_id, run) - min(word) OVER (PARTITION BY doc_id, run) AS size FROM z)
SELECT doc_id, para::INT AS para, word::INT AS word, words::INT AS words, size::INT AS passage_words, kept // 100000 AS kept_doc_id, (kept % 100000)::INT AS kept_para, id = kept AS kept FROM f WHERE size >= 30
"""
