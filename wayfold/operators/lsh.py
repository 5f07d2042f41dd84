"""MinHash signatures of node sets, bands, candidates and similarity."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.tiles import Network

PRIME, RANGE, FUNCTIONS, BANDS = 34_359_738_421, 100_000_000, 30, 15


def coefficients() -> list[tuple[int, int]]:
    """(a, b) of the hash functions, drawn in order from a generator seeded with 42."""
    rng = random.Random(42)
    a = [rng.randint(100, 400) for _ in range(FUNCTIONS)]
    return list(zip(a, [rng.randint(1, 200) for _ in range(FUNCTIONS)], strict=True))


def hash_of(x: Column, a: int, b: int) -> Column:
    return (x.cast("long") * a + b) % PRIME % RANGE


def hashes(nodes: np.ndarray) -> np.ndarray:
    """`hash_of` in arrays: a row a node, a column a function."""
    a, b = (np.array(x, np.int64) for x in zip(*coefficients(), strict=True))
    return np.fmod(np.fmod(nodes.astype(np.int64)[:, None] * a + b, PRIME), RANGE)


def banded_hashes(nodes: np.ndarray) -> np.ndarray:
    """The functions that `bands` reads, in half the columns of `hashes`."""
    return hashes(nodes)[:, :BANDS]


def signatures(near: DataFrame, key: str = "src") -> DataFrame:
    """(key, signature): the least value of each hash function over the nodes of a key; one aggregation, combined map-side."""
    least = [F.min(hash_of(F.col("node"), a, b)) for a, b in coefficients()]
    return near.groupBy(key).agg(F.array(*least).alias("signature"))


def merged(o: Column, d: Column) -> Column:
    """o0, d0, o1, d1, ..."""
    return F.flatten(F.zip_with(o, d, lambda x, y: F.array(x, y)))


def bands(both: Column) -> Column:
    """Of a merged signature: the sums of its first 15 pairs, so functions beyond the fifteenth do not count."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: (F.get(both, i * 2) + F.get(both, i * 2 + 1)) % RANGE)


def candidates(banded: DataFrame) -> DataFrame:
    """(user_id, cand_id, n_buckets): earlier riders in one of the rider's buckets (banded: user_id, buckets)."""
    each = banded.select("user_id", F.explode(F.array_distinct("buckets")).alias("bucket"))
    other = each.select(F.col("user_id").alias("cand_id"), "bucket")
    return each.join(other, "bucket").where("user_id > cand_id").groupBy("user_id", "cand_id").agg(F.count("*").alias("n_buckets"))


def similarity(pairs: DataFrame, snapped: DataFrame, knn: DataFrame) -> DataFrame:
    """Adds total and sim: exp(-(d_orig + d_dest) / 1000) by network distance from the candidate's nodes, 1 at no distance, -1 where one is not near."""
    at = lambda who, side: snapped.where(F.col("side") == side).select(F.col("user_id").alias(who), F.col("node").alias(f"{who}_{side}"))
    out = pairs
    for side in ("orig", "dest"):
        out = out.join(at("user_id", side), "user_id").join(at("cand_id", side), "cand_id")
        d = knn.select(F.col("src").alias(f"cand_id_{side}"), F.col("node").alias(f"user_id_{side}"), F.col("dist").alias(f"d_{side}"))
        out = out.join(d, [f"cand_id_{side}", f"user_id_{side}"], "left")
    total = F.col("d_orig") + F.col("d_dest")
    return out.select(*pairs.columns, total.alias("total"), F.when(total.isNull(), -1.0).when(total == 0, 1.0).otherwise(F.exp(-total / 1000)).alias("sim"))


def network_similarity(pairs: DataFrame, snapped: DataFrame, network: Network) -> DataFrame:
    """`similarity` with distances searched on the network for the pairs' nodes only."""
    out = pairs
    for side in ("orig", "dest"):
        for who, as_ in (("cand_id", "src"), ("user_id", "other")):
            out = out.join(snapped.where(F.col("side") == side).select(F.col("user_id").alias(who), F.col("node").alias(as_)), who)
        out = network.between(out).withColumnRenamed("dist", f"d_{side}")
    total = F.col("d_orig") + F.col("d_dest")
    return out.select(*pairs.columns, total.alias("total"), F.when(total.isNull(), -1.0).when(total == 0, 1.0).otherwise(F.exp(-total / 1000)).alias("sim"))


def top_two(similar: DataFrame, threshold: float = 0.5) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("sim"), "cand_id")
    return similar.where(F.col("sim") >= threshold).withColumn("rank", F.row_number().over(order)).where("rank <= 2")
