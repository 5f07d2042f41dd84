"""Shared pieces: table reading, the shared work folder, chunk tables for Python workers."""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches hold few of them and workers need little memory.
BATCH_ROWS = 512
#: Entries a worker keeps in a chunk table before it starts it anew.
TABLE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by Spark's own readers only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matching(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """`rows` joined with `keyed`, a written table, on `key`: of up to MOST_SENT keys only the rows that match are shuffled, and not all texts."""
    keys = keyed.select(key).distinct()
    some = rows.join(F.broadcast(keys), key, "left_semi") if keys.limit(MOST_SENT + 1).count() <= MOST_SENT else rows
    return some.join(keyed, key)


@contextlib.contextmanager
def large_batches(spark: SparkSession, rows: int = 65_536) -> Iterator[None]:
    """Arrow batches of `rows` rows for what runs inside: for tables of a few numbers a row, not for texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of ids or hashes that are broadcast at most (some 50 bytes each); more are joined by shuffling.
MOST_SENT = 150_000


def sendable(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """`df`, marked to be broadcast if it has at most `most` rows; `df` is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where that is unset a temporary one, for a local master (tests) only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables written in each open scratch(), the innermost last.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for those given to what this yields, which go with the scratch around this one, if any."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_to)
        return df

    _scratch.append([])
    try:
        yield keep
    finally:
        paths = _scratch.pop()
        for path in paths:
            if path not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif _scratch:
                _scratch[-1].append(path)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes `df` to the shared folder and reads it again: lineage ends here, and lost executors cost no recomputation."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _scratch:
        _scratch[-1].append(path)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text, null read as empty: extra columns never reach an operator."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's own key, made of its content: (absent, doc_id, text_hash), so rows without a doc_id come last; only rows equal in doc_id and text share one."""
    return F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids on which classifiers are measured and never fitted."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks_of(text: str) -> list[str]:
    """The text cut at blanks, tabs and line ends; there may be empty chunks."""
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")


class ChunkTable(dict):
    """chunk -> value. Values of chunks not seen before are computed in one call a batch; the table is emptied down to its fixed part when it has grown past `entries`."""

    def __init__(self, compute: Callable[[list[str]], Iterable], fixed: dict | None = None, entries: int = TABLE_ENTRIES):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.entries = compute, fixed or {}, entries

    def unknown(self, lists: Iterable[list[str]]) -> list[str]:
        """Looked up one by one: set.difference would go through all entries of a table that is no plain dict."""
        return [*itertools.filterfalse(self.__contains__, set().union(*lists))]

    def learn(self, lists: Iterable[list[str]]) -> None:
        new = self.unknown(lists)
        if len(self) + len(new) > self.entries:
            self.clear()
            self.update(self.fixed)
            new = self.unknown(lists)
        if new:
            self.update(zip(new, self.compute(new), strict=True))


class WordTable(dict):
    """word -> hash, made where it is looked up first; `learn` before a batch empties a table that has grown past `entries`."""

    def __init__(self, of: Callable[[bytes], int], entries: int = TABLE_ENTRIES):
        super().__init__()
        self.of, self.entries = of, entries

    def __missing__(self, word: bytes) -> int:
        self[word] = out = self.of(word)
        return out

    def learn(self, lists: Iterable[list[bytes]] = ()) -> None:
        if len(self) > self.entries:
            self.clear()
