"""Queries of order-dependent grouping and of generation; SQL can't express these, so tests compare them with plain models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions.geo import point_in_circle
from wayfold.operators import clusters, commit, intercity, lsh
from wayfold.operators import network as net
from wayfold.plans import network as plans
from wayfold.plans.base import query
from wayfold.sources import fixtures as fx

REMOVED = range(5, 10_000, 17)


def _meeting(spark, d, removed=()):
    scored, who, network = plans.meeting_pairs(spark, d)
    pairs = net.checkpointed(scored.select("user_id", "cand_id", "total"))
    return commit.meeting_groups(network.nearest(commit.meeting_riders(who, pairs, removed), ranked=False).drop("src"), pairs, removed)


@query()
def mpb_groups(spark, d):
    return _meeting(spark, d)


@query()
def mpb_remove(spark, d):
    return _meeting(spark, d, REMOVED)


def _similar(spark, d):
    network, at, cand = plans._lsh_candidates(spark, d)
    return net.checkpointed(lsh.network_similarity(cand.select("user_id", "cand_id"), at, network).where("sim >= 0.5").select("user_id", "cand_id", "sim"))


@query()
def lsh_groups(spark, d):
    return commit.pair_groups(_similar(spark, d), "minhash")


@query()
def lsh_remove(spark, d):
    return commit.pair_groups(_similar(spark, d), "minhash", REMOVED)


@query()
def mips_groups(spark, d):
    return commit.pair_groups(net.checkpointed(plans._cosines(spark, d).withColumnRenamed("cos", "sim")), "cosine")


@query()
def intercity_groups(spark, d):
    r = fx.ride_intercity(spark, d)
    return commit.intercity_groups(r, net.checkpointed(intercity.matching_pairs(r, fx.route(spark, d)).select("a", "b")))


@query()
def storage_fold(spark, d):
    return commit.stored_states(fx.location_event(spark, d).withColumn("store", F.col("user_id") % 20), "store")


@query()
def od_pairs(spark, d):
    """Trips around hot spots, every 97th node: nodes within 500 m of it, each with its first hot spot only, in an order by hash, are paired as origins and destinations; 20 a hot spot at most, as the generator's setting asks."""
    nodes, edges = fx.road_node(spark, d), fx.road_edge(spark, d)
    spots = nodes.where("node_id % 97 = 0").select(F.col("node_id").alias("src"))
    ball = net.shortest(spots, edges, 500.0).groupBy("node").agg(F.min("src").alias("spot"))
    order = Window.partitionBy("spot").orderBy(F.xxhash64("node", F.lit(7)), "node")
    ranked = ball.withColumn("r", F.row_number().over(order))
    o = ranked.where("r % 2 = 1").select("spot", F.expr("(r + 1) div 2").alias("k"), F.col("node").alias("orig_node"))
    t = ranked.where("r % 2 = 0").select("spot", F.expr("r div 2").alias("k"), F.col("node").alias("dest_node"))
    return o.join(t, ["spot", "k"]).where("k <= 20")


@query()
def random_users(spark, d):
    """Riders around given centres, uniform in a circle of 1 km, from hashes of their ids."""
    u = lambda seed: F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    r = fx.ride_request(spark, d).select("user_id")
    ends = {}
    for k, e in enumerate(("origin", "destination")):
        ends[f"{e}_lat"], ends[f"{e}_lng"] = point_in_circle(F.lit(35.95), F.lit(50.72), F.lit(1000.0), u(2 * k), u(2 * k + 1))
    return r.withColumns(ends)


@query()
def event_log_json(spark, d):
    """The event log as JSON lines, written and read again."""
    from wayfold.sources.registry import read_events, write_events

    return read_events(spark, write_events(fx.location_event(spark, d).select("seq", "op", "user_id", "ts")))


@query()
def metrics_report(spark, d):
    """The evaluation as one JSON document."""
    m = clusters.members(fx.ride_request(spark, d), fx.cluster_assign(spark, d))
    return clusters.evaluation(m).select(F.to_json(F.struct("*")).alias("report"))
