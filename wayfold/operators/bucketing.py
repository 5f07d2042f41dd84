"""Meeting points: riders meet where both can walk to, at either end."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.tiles import Network


def side_scores(near: DataFrame) -> DataFrame:
    """(user_id, cand_id, side, shared, score, node) of riders (near: user_id, side, node, dist) and earlier riders who share nodes.

    score is the least sqrt(d_user^2 + d_cand^2) / 2 over shared nodes, node where it is reached (ties: the least).
    """
    a, b = near.alias("a"), near.select(F.col("user_id").alias("cand_id"), "side", "node", F.col("dist").alias("cand_dist"))
    both = a.join(b, ["side", "node"]).where("user_id > cand_id")
    scored = both.select("user_id", "cand_id", "side", "node", (F.sqrt(F.col("dist") * F.col("dist") + F.col("cand_dist") * F.col("cand_dist")) / 2).alias("score"))
    out = scored.groupBy("user_id", "cand_id", "side").agg(F.count("*").alias("shared"), F.min(F.struct("score", "node")).alias("best"))
    return out.select("user_id", "cand_id", "side", "shared", "best.score", "best.node")


def pairs(near: DataFrame) -> DataFrame:
    """Pairs that share nodes on both sides, in one aggregation: a side that is missing drops the pair."""
    s = side_scores(near)
    by = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = s.groupBy("user_id", "cand_id").agg(
        by("orig", "shared").alias("n_orig"), by("dest", "shared").alias("n_dest"), by("orig", "score").alias("orig_score"), by("dest", "score").alias("dest_score"), by("orig", "node").alias("orig_node"), by("dest", "node").alias("dest_node")
    )
    return out.where("n_orig IS NOT NULL AND n_dest IS NOT NULL").withColumn("total", F.col("orig_score") + F.col("dest_score"))


def riders(at: DataFrame, network: Network) -> DataFrame:
    """(user_id, o, d, o_cells, d_cells, o_mass, d_mass) of snapped ends (user_id, side, node): the node at either end, null without one, and what `Network.cells` has of it."""
    c = network.cells(at.select("user_id", "side", F.col("node").alias("src")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("src", "cells", "mass")))
    both = c.groupBy("user_id").agg(of("orig").alias("a"), of("dest").alias("b"))
    return both.select("user_id", F.col("a.src").alias("o"), F.col("b.src").alias("d"), F.col("a.cells").alias("o_cells"), F.col("b.cells").alias("d_cells"), F.col("a.mass").alias("o_mass"), F.col("b.mass").alias("d_mass"))


def candidates(who: DataFrame) -> DataFrame:
    """(user_id, cand_id, o, d, cand_o, cand_d): riders and earlier riders whose near nodes lie in a common cell at both ends. All who share nodes at both ends are among them."""
    each = who.select("user_id", "o", "d", F.explode("o_cells").alias("co"), "d_cells").withColumn("cd", F.explode("d_cells")).drop("d_cells")
    other = each.select(F.col("user_id").alias("cand_id"), F.col("o").alias("cand_o"), F.col("d").alias("cand_d"), "co", "cd")
    return each.join(other, ["co", "cd"]).where("user_id > cand_id").select("user_id", "cand_id", "o", "d", "cand_o", "cand_d").distinct()


def network_pairs(cands: DataFrame, network: Network) -> DataFrame:
    """`pairs` of candidates: near nodes are searched for these only, and the destination's for those who share nodes at the origin."""
    o = network.meet(cands.withColumnsRenamed({"o": "src", "cand_o": "other"})).withColumnsRenamed({"shared": "n_orig", "score": "orig_score", "node": "orig_node"}).drop("dot")
    d = network.meet(o.withColumnsRenamed({"d": "src", "cand_d": "other"})).withColumnsRenamed({"shared": "n_dest", "score": "dest_score", "node": "dest_node"})
    return d.select("user_id", "cand_id", "n_orig", "n_dest", "orig_score", "dest_score", "orig_node", "dest_node", (F.col("orig_score") + F.col("dest_score")).alias("total"))


def most_total(threshold: float = 0.5, scale: float = 1000.0) -> float:
    """The total at which exp(-total / scale) is the threshold; compared in metres, so no exponential is taken a pair."""
    return -scale * math.log(threshold)


def best_partner(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each rider's best earlier partner among those who pass the threshold (ties: the earliest)."""
    fit = scored.where(F.col("total") <= most_total(threshold))
    best = fit.groupBy("user_id").agg(F.min(F.struct("total", "cand_id", "orig_node", "dest_node")).alias("b"))
    return best.select("user_id", "b.cand_id", "b.total", "b.orig_node", "b.dest_node")
