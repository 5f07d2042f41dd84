"""Gaussian-weighted node vectors and cosine similarity, on sparse rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import gaussian_weight
from wayfold.operators import bucketing
from wayfold.operators.tiles import Network


def features(near: DataFrame, n_nodes: int) -> DataFrame:
    """(user_id, dim, w): origin nodes are dimensions 0 to n-1, destination nodes n to 2n-1."""
    dim = F.col("node") + F.when(F.col("side") == "dest", n_nodes).otherwise(0)
    return near.select("user_id", dim.alias("dim"), gaussian_weight(F.col("dist")).alias("w"))


def sparse_pairs(feat: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(user_id, cand_id, cos) of pairs, the later rider first, with cosine >= threshold: only shared dimensions meet."""
    norm = feat.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = feat.join(norm, "user_id").select("user_id", "dim", (F.col("w") / F.col("norm")).alias("w"))
    other = unit.select(F.col("user_id").alias("cand_id"), "dim", F.col("w").alias("v"))
    dots = unit.join(other, "dim").where("user_id > cand_id").groupBy("user_id", "cand_id").agg(F.sum(F.col("w") * F.col("v")).alias("cos"))
    return dots.where(F.col("cos") >= threshold)


def network_pairs(who: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """`sparse_pairs` of riders (as of `bucketing.riders`) by the weights of their near nodes; only candidates' nodes are searched.

    Pairs that share nodes at both ends meet by cells of both. Pairs that share at one end have a cosine of at most the product
    of their unit vectors' lengths there, so they meet by cells of one end if that reaches the threshold.
    """
    who = who.withColumn("norm", F.sqrt(F.coalesce("o_mass", F.lit(0.0)) + F.coalesce("d_mass", F.lit(0.0))))
    long = who.select("user_id", "o", "d", "o_cells", "d_cells", (F.sqrt("o_mass") / F.col("norm")).alias("o_part"), (F.sqrt("d_mass") / F.col("norm")).alias("d_part"))
    most = long.agg(F.max("o_part").alias("o"), F.max("d_part").alias("d")).first()
    cands, least = bucketing.candidates(who), threshold - 1e-9
    for e in "od":
        if most[e] is None or most[e] * most[e] < least:
            continue
        one = long.where(F.col(f"{e}_part") * most[e] >= least).select("user_id", "o", "d", F.col(f"{e}_part").alias("part"), F.explode(f"{e}_cells").alias("cell"))
        other = one.select(F.col("user_id").alias("cand_id"), F.col("o").alias("cand_o"), F.col("d").alias("cand_d"), F.col("part").alias("cand_part"), "cell")
        cands = cands.unionByName(one.join(other, "cell").where((F.col("user_id") > F.col("cand_id")) & (F.col("part") * F.col("cand_part") >= least)).select(*cands.columns)).distinct()
    ends = F.array(*(F.struct(F.col(e).alias("src"), F.col(f"cand_{e}").alias("other")) for e in "od"))
    dots = network.meet(cands.select("user_id", "cand_id", F.explode(ends).alias("e")).select("user_id", "cand_id", "e.*")).groupBy("user_id", "cand_id").agg(F.sum("dot").alias("dot"))
    norm = who.select("user_id", "norm")
    both = dots.join(norm, "user_id").join(norm.select(F.col("user_id").alias("cand_id"), F.col("norm").alias("cand_norm")), "cand_id")
    return both.select("user_id", "cand_id", (F.col("dot") / (F.col("norm") * F.col("cand_norm"))).alias("cos")).where(F.col("cos") >= threshold)


def dense_pairs(vectors: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, cos), a < b, of dense vectors (vec_id, embedding) with cosine >= threshold.

    Exact: every pair is compared, a block of vectors with a block, so a task holds two blocks and no pair is a row before it passes.
    """
    blocks = max(1, -(-vectors.count() // 2000))
    v = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.expr("transform(embedding, x -> double(x))").alias("e")).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    dealt = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "e")

    def compare(key: tuple, data: pa.Table) -> pa.Table:
        x = np.array(data.column("e").to_pylist())
        ids, own = data.column("vec_id").to_numpy(), data.column("own").to_numpy()
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        left, right = (np.flatnonzero(own == k.as_py()) for k in key)
        cos = x[left] @ x[right].T
        r, c = np.nonzero((cos >= threshold) & (ids[left][:, None] != ids[right][None, :]))
        a, b = ids[left][r], ids[right][c]
        keep = a < b if key[0].as_py() == key[1].as_py() else np.ones(len(a), bool)
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cos": cos[r, c][keep]})

    return dealt.groupBy("i", "j").applyInArrow(compare, "a long, b long, cos double")
