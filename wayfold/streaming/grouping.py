"""Live grouping: a stream of arrivals and removals, folded in order with the state kept between micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.commit import storage_fold

#: Users that must be pending before groups are formed.
GATE = 3


def region_of(events: DataFrame, cell: float = 0.05) -> DataFrame:
    """Adds region, the grid cell of the origin: riders of one region are grouped by one state, so regions scale out."""
    at = lambda c: F.floor(F.col(c) / cell).cast("string")
    return events.withColumn("region", F.concat_ws(":", at("lat"), at("lng")))


def states(events: DataFrame, key: str = "region") -> DataFrame:
    """Stream (key, seq, op, user_id) -> updates (key, user_id, state) of the users that a batch changed.

    The state of a key is its events so far that still matter: those of users present. Late events are folded by seq within
    their batch; a removal takes the user's rows out of the state.
    """

    def fold(k: tuple, batches, state: GroupState):
        kept = list(map(tuple, state.get[0])) if state.exists else []
        before = dict(storage_fold(kept))
        new = [(int(s), str(o), int(u)) for b in batches for s, o, u in b[["seq", "op", "user_id"]].itertuples(index=False)]
        after = dict(storage_fold(kept + new))
        changed = sorted(u for u in before.keys() | after.keys() if before.get(u) != after.get(u))
        live = [e for e in sorted(kept + new) if e[2] in after or e[1] == "remove" and any(x[2] in after for x in kept)]
        state.update((live,))
        yield pd.DataFrame([(k[0], u, after.get(u, "removed")) for u in changed], columns=["key", "user_id", "state"])

    rows = events.select(F.col(key).cast("string").alias("key"), "seq", "op", "user_id")
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, user_id long, state string", "events array<struct<seq: long, op: string, user_id: long>>", "update", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def waiting_rows(rows: DataFrame) -> DataFrame:
    """Without the adds of users that are waiting already: the first add stays, until a removal. Rows without `op` are adds; their order is seq, or else the batch."""
    op = F.col("op") if "op" in rows.columns else F.lit("add")
    before = Window.partitionBy("user_id").orderBy("seq" if "seq" in rows.columns else "_batch").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(op.isin("add", "remove"), op), ignorenulls=True).over(before)
    again = (op == "add") & (F.col("_last") == "add") & F.col("user_id").isNotNull()
    return rows.withColumn("_last", last).where(~F.coalesce(again, F.lit(False))).drop("_last")


def pending_count(rows: DataFrame) -> int:
    """Users whose last add or removal is an add."""
    op = F.col("op") if "op" in rows.columns else F.lit("add")
    ends = rows.where(op.isin("add", "remove") & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max_by(op, F.col("seq" if "seq" in rows.columns else "_batch")).alias("op"))
    return ends.where("op = 'add'").count()


def run_batches(events: DataFrame, handle: Callable[[DataFrame, int], Iterable[int] | None], checkpoint: str, seconds: int | None = 5, gate: int = GATE) -> StreamingQuery:
    """Gives the rows that wait to `handle` as soon as `gate` users are pending; with no `seconds` all that is there is processed and the query ends.

    The rows of every micro-batch, arrivals and removals, are kept under `checkpoint`, so those of a batch too small for the
    gate come with a later one. `handle` may return the ids of users that it leaves pending: their rows wait on and count for
    the next batch; all other rows are done with. An error in a batch ends the query, which starts again from its checkpoint
    with the rows that waited before that batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = lambda k: f"{checkpoint.rstrip('/')}/waiting/{k}"
        rows = batch.withColumn("_batch", F.lit(number).cast("long"))
        fs, before = _folder(spark, path(number - 1))
        if fs.exists(before):
            rows = spark.read.schema(rows.schema).parquet(path(number - 1)).unionByName(rows)
        rows = waiting_rows(rows).persist()
        try:
            left = rows
            if pending_count(rows) >= gate:
                still = list(handle(rows.drop("_batch"), number) or ())
                left = rows.where(F.col("user_id").isin(still))
            left.write.mode("overwrite").parquet(path(number))
        finally:
            rows.unpersist()
        fs.delete(_folder(spark, path(number - 2))[1], True)  # a batch that is run again needs the one before it

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
