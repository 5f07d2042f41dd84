"""Requests, groups and their state as tables: first and last writes, groups, notifications, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.network import checkpointed


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Adds each row's position from 1 in the order given, over all rows, without bringing them into one task.

    Rows are range-partitioned and sorted; a partition's rows are numbered by themselves, after the rows of those before it.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = checkpointed(rows)
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    base = df.sparkSession.createDataFrame(before, "_part int, _base long")
    return rows.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at") + 1).select(*df.columns, name)


def first_writes(events: DataFrame) -> DataFrame:
    """The first add of each user wins."""
    first = events.where("op = 'add'").groupBy("user_id").agg(F.min(F.struct("seq", "lat", "lng")).alias("f"))
    return first.select("user_id", "f.seq", "f.lat", "f.lng")


def last_writes(events: DataFrame) -> DataFrame:
    """The last event of each user, unless it removes the user."""
    last = events.groupBy("user_id").agg(F.max(F.struct("seq", "op", "lat", "lng")).alias("l"))
    return last.where("l.op <> 'remove'").select("user_id", "l.seq", "l.lat", "l.lng")


def status_of(size: Column) -> Column:
    return F.when(size == 3, "complete").when(size == 2, "forming").otherwise("expired")


def groups(rows: DataFrame) -> DataFrame:
    """(group_id, users sorted by id, size, status, created_at, mean ends) of (group_id, user_id, ...)."""
    ends = [F.avg(f"{e}_{c}").alias(f"{e}_{c}") for e in ("origin", "destination") for c in ("lat", "lng")]
    g = rows.groupBy("group_id").agg(F.array_sort(F.collect_set("user_id")).alias("users"), F.min("stored_at").alias("created_at"), *ends)
    return g.withColumn("size", F.size("users").cast("long")).withColumn("status", status_of(F.col("size")))


def notifications(g: DataFrame) -> DataFrame:
    """One message a member of each group: companions and meeting point."""
    each = g.select("group_id", "created_at", "origin_lat", "origin_lng", F.explode("users").alias("user_id"), "users")
    mates = F.filter("users", lambda u: u != F.col("user_id"))
    return each.select("user_id", "group_id", F.array_join(mates.cast("array<string>"), ",").alias("companions"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.round("origin_lat", 6).alias("meet_lat"), F.round("origin_lng", 6).alias("meet_lng"))


def api_state(events: DataFrame) -> DataFrame:
    """Upserts by key, removals delete: the state after all events (key, seq, op, value)."""
    last = events.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("l"))
    return last.where("l.op <> 'remove'").select("key", "l.seq", "l.value")
