"""Sources and sinks by name."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False), *(T.StructField(c, T.DoubleType(), False) for c in ("origin_lat", "origin_lng", "destination_lat", "destination_lng")),
        T.StructField("stored_at", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("passengers", T.IntegerType()),
    ]
)
EVENT = "seq long, op string, user_id long, ts timestamp"

SOURCES: dict[str, Callable[..., DataFrame]] = {}
SINKS: dict[str, Callable[..., None]] = {}


def source(name: str):
    def add(f):
        SOURCES[name] = f
        return f

    return add


def sink(name: str):
    def add(f):
        SINKS[name] = f
        return f

    return add


def read(spark: SparkSession, kind: str, **options) -> DataFrame:
    """The rows of a source; an unknown kind is an error."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; known: {sorted(SOURCES)}")
    return SOURCES[kind](spark, **options)


def write(df: DataFrame, kinds: Iterable[str], **options) -> list[tuple[str, str]]:
    """Gives rows to every sink named. Unknown kinds are skipped; a sink that fails does not stop the others, and its error is returned."""
    errors = []
    for kind in kinds:
        if kind in SINKS:
            try:
                SINKS[kind](df, **options)
            except Exception as e:  # noqa: BLE001  one sink's failure is reported, not raised
                errors.append((kind, str(e)))
    return errors


@source("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@source("json")
def json(spark: SparkSession, path: str, schema=REQUEST) -> DataFrame:
    return spark.read.schema(schema).json(path)


@source("od_json")
def od_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of four-number arrays: origin and destination."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "array<array<double>>")).alias("user_id", "x"))
    return rows.select(F.col("user_id").cast("long"), *(F.col("x")[i].alias(c) for i, c in enumerate(("origin_lat", "origin_lng", "destination_lat", "destination_lng"))))


@source("jdbc")
def jdbc(spark: SparkSession, **options) -> DataFrame:
    """A database table; needs the driver's jar."""
    return spark.read.format("jdbc").options(**options).load()


@source("stream")
def stream(spark: SparkSession, path: str, schema=REQUEST, files_per_trigger: int = 1) -> DataFrame:
    """A folder that JSON files arrive in, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of the sources, columns by name; a missing column is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@sink("parquet")
def to_parquet(df: DataFrame, path: str, **_) -> None:
    df.write.mode("append").parquet(path)


@sink("json")
def to_json(df: DataFrame, path: str, records_per_file: int = 100_000, **_) -> None:
    """JSON lines; a file ends after so many records."""
    df.write.mode("append").option("maxRecordsPerFile", records_per_file).json(path)


@sink("callback")
def to_callback(df: DataFrame, callback, **_) -> None:
    callback(df)


def write_events(events: DataFrame) -> str:
    """Writes an event log to the shared folder and gives its path."""
    spark = events.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="wayfold-")
    path = f"{folder}/events-{uuid.uuid4().hex}"
    to_json(events, path)
    return path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return json(spark, path, EVENT)
