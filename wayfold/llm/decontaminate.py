"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import row_key, scratch, sendable, table, written

#: Words are runs of letters and digits of the lower-cased text.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Rows of sketches that are broadcast at most (16 bytes each); more are joined by shuffling.
MOST_BROADCAST = 1_000_000
#: Candidate pairs that are sent with their items' shingles (some 500 bytes each) at most.
MOST_PAIRS = 20_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def runs(w: Column, *sizes: int) -> Column:
    """Hashes of the runs of words of each of these sizes.

    The words are bound to a lambda's variable, so they are made once a row and not once for each run.
    """

    def of(ws: Column, size: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(size))))
        return F.when(F.size(ws) >= size, each).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(w), lambda ws: F.concat(*(of(ws, k) for k in sizes))), 0)


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words, sh) of the items that have words: the hashes of the runs of `size` words, or of fewer words all of them as one; rows of one id have the shingles of all."""
    w = items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    own = F.coalesce(*(F.when(F.size("w") == k, runs(F.col("w"), k)) for k in range(1, size)), runs(F.col("w"), size))
    each = w.where("size(w) > 0").select("item_id", F.least(F.size("w"), F.lit(size)).alias("words"), F.explode(own).alias("h"))
    return each.groupBy("item_id").agg(F.collect_set("words").alias("words"), F.array_sort(F.collect_set("h")).alias("sh"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(h, item_id, least) of the bottom hashes of each item (item_id, sh: its distinct shingles).

    Items are partitioned by the power of two of their size; all of a partition keep the same number of bottom MinHash values,
    one more than the shingles that its largest item may miss. So a document with the share `threshold` of an item's shingles
    holds one value of its sketch at least: the search loses nothing. `least` is the shingles that a document must have.
    """
    size = F.size("sh")
    sized = items.where(size > 0).withColumn("bucket", F.floor(F.log2(size.cast("double"))).cast("int"))
    most = sized.groupBy("bucket").agg(F.max(size).alias("most"))  # a row for each power of two
    sized = sized.join(F.broadcast(most), "bucket").withColumn("k", (F.floor((1 - threshold) * F.col("most") + 1e-9) + 1).cast("int"))
    bottom = F.slice(F.array_sort(F.transform("sh", lambda h: F.struct(F.xxhash64(h, F.lit(17)).alias("o"), h.alias("h")))), 1, F.col("k"))
    return sized.select("item_id", F.ceil(threshold * size - 1e-9).alias("least"), F.explode(bottom).alias("b")).select("b.h", "item_id", "least")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """Rows (doc_id, item_id, shared, item_shingles, containment) where a document has the share `threshold` of an item's distinct shingles.

    Candidates come from the sketches, and each is verified by all of its shingles, compared by 64-bit hashes. An item of fewer
    than `size` words is one shingle of its own size, found anywhere in a document. Null and empty texts hold nothing and null
    and empty items are in nothing; null ids are left out; rows with one id count as one document (or item) with the shingles
    of all; other columns are left out; an empty table gives none. Whole texts are searched, however long.
    """
    sets = written(item_shingles(items, size), "items")
    sizes = sorted({size, *(r.k for r in sets.select(F.explode("words").alias("k")).distinct().collect())})  # `size` numbers at most
    marks = sendable(sketches(sets, threshold), MOST_BROADCAST)
    own = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    hashed = own.select("doc_id", runs(words(F.col("text")), *sizes).alias("sh"))
    found = hashed.select("doc_id", F.size("sh").alias("n"), F.explode("sh").alias("h")).join(marks, "h").where("n >= least")
    pairs = written(found.select("doc_id", "item_id").distinct(), "candidates")
    wanted = pairs.join(sets.select("item_id", "sh"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "sh")).alias("items"))
    # texts are shuffled only where the candidates are too many to be sent
    named = own.join(F.broadcast(wanted), "doc_id") if pairs.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS else own.join(wanted, "doc_id")
    each = named.select("doc_id", runs(words(F.col("text")), *sizes).alias("all"), F.explode("items").alias("i"))
    both = each.select("doc_id", "i.item_id", F.size("i.sh").cast("long").alias("item_shingles"), F.explode(F.array_intersect("i.sh", "all")).alias("h"))
    merged = both.groupBy("doc_id", "item_id", "item_shingles").agg(F.countDistinct("h").alias("shared"))
    out = merged.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    return out.where(F.col("shared") >= F.ceil(threshold * F.col("item_shingles") - 1e-9))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`contaminated` of all documents by all benchmark items at its defaults."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go.

    Rows are told apart by doc_id and text, so rows of one doc_id are decided each for itself, and those without a doc_id too.
    Null and empty texts hold nothing and stay; repeated rows stay or go alike; columns of any name are kept; an empty table
    gives none, and an empty benchmark takes none.
    """
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = numbered.withColumn("row", row_key(at["doc_id"], at["text"]))
    with scratch(spark) as keep:
        found = contaminated(rows.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text")), table(spark, sf_dir, "benchmark"))
        bad = keep(written(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated"))
    return rows.join(sendable(bad), "row", "left_anti").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS x FROM d, z),
bs AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 5) + 2)]) AS x FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, n.n::BIGINT AS item_shingles, count(*) / n.n::DOUBLE AS containment
FROM ds JOIN bs USING (x) JOIN n USING (item_id) GROUP BY doc_id, item_id, n.n HAVING count(*) >= ceil(0.8::DOUBLE * n.n - 1e-9)
"""
