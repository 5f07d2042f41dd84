"""Snapping to the street network, bounded shortest paths and nearest-node tables."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_m
from wayfold.operators.tiles import Network

#: Edges of a graph that is broadcast to workers at most (12 bytes each, and 16 a node); larger graphs are relaxed by joins.
MOST_EDGES = 2_000_000
METRES_A_DEGREE = 111_194.0


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read again: no recomputation, no loss with an executor."""
    import tempfile

    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def snap(points: DataFrame, nodes: DataFrame, cell: float = 0.002, k: int = 1) -> DataFrame:
    """The `k` nearest nodes (node_id, lat, lng) of each point (point_id, lat, lng) by great circle: point_id, node, dist_m, rank.

    Points and nodes meet by equi-join on grid cells: a point looks into the 3 x 3 cells around its own. Where these can't
    hold all `k` nearest for certain, the point looks again into cells four times as wide, until none is left. Ties go to the
    least node. Points or nodes without coordinates are left out.
    """
    points = points.where("lat IS NOT NULL AND lng IS NOT NULL").select("point_id", "lat", "lng")
    nodes = nodes.where("lat IS NOT NULL AND lng IS NOT NULL").select("node_id", F.col("lat").alias("nlat"), F.col("lng").alias("nlng"))
    if k == 1:
        return _snap_one(points, nodes, cell)
    found, left = None, points
    order = Window.partitionBy("point_id").orderBy("dist_m", "node_id")
    total = nodes.count()
    while total:
        at = lambda c: F.floor(F.col(c) / cell).cast("long")
        ring = F.array(*(F.lit(d) for d in (-1, 0, 1)))
        looks = left.withColumns({"cy": at("lat"), "cx": at("lng")}).withColumn("dy", F.explode(ring)).withColumn("dx", F.explode(ring)).withColumns({"cy": F.col("cy") + F.col("dy"), "cx": F.col("cx") + F.col("dx")})
        near = looks.join(nodes.withColumns({"cy": at("nlat"), "cx": at("nlng")}), ["cy", "cx"])
        ranked = near.select("point_id", "lat", "lng", "node_id", haversine_m(F.col("lat"), F.col("lng"), F.col("nlat"), F.col("nlng")).alias("dist_m")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # whatever lies within one cell's width is in the cells looked into; degrees of longitude are narrower by the cosine
        sure = F.lit(cell * METRES_A_DEGREE) * F.cos(F.radians(F.least(F.abs("lat") + cell, F.lit(89.9))))
        full = ranked.groupBy("point_id").agg(F.count("*").alias("_n"), F.max(F.col("dist_m") - sure).alias("_over")).where((F.col("_n") >= min(k, total)) & (F.col("_over") <= 0)).select("point_id")
        done = ranked.join(full, "point_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        left = left.join(full, "point_id", "left_anti")
        if cell > 360 or not left.limit(1).count():
            if cell > 360:
                found = found.unionByName(ranked.join(full, "point_id", "left_anti"))
            break
        cell *= 4
    if found is None:
        return points.select("point_id", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("dist_m"), F.lit(1).alias("rank")).limit(0)
    return found.select("point_id", F.col("node_id").alias("node"), "dist_m", "rank")


def _snap_one(points: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """`snap` for one node a point: nodes are put into the 3 x 3 cells around their own, so a point meets all of them in one task and becomes one row there. Each round is written once."""
    found, left = None, points
    ring = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    some = nodes.limit(1).count() > 0
    while some:
        at = lambda c: F.floor(F.col(c) / cell).cast("long")  # noqa: E731, B023
        around = nodes.withColumn("dy", F.explode(ring)).withColumn("dx", F.explode(ring)).select("node_id", "nlat", "nlng", (at("nlat") + F.col("dy")).alias("cy"), (at("nlng") + F.col("dx")).alias("cx"))
        near = left.withColumns({"cy": at("lat"), "cx": at("lng")}).join(around.hint("merge"), ["cy", "cx"])
        best = near.groupBy("cy", "cx", "point_id", "lat", "lng").agg(F.min(F.struct(haversine_m(F.col("lat"), F.col("lng"), F.col("nlat"), F.col("nlng")).alias("d"), "node_id")).alias("b"))
        # whatever lies within one cell's width is in the cells looked into; degrees of longitude are narrower by the cosine
        sure = F.lit(cell * METRES_A_DEGREE) * F.cos(F.radians(F.least(F.abs("lat") + cell, F.lit(89.9))))
        done = checkpointed(best.where(F.lit(cell > 360) | (F.col("b.d") <= sure)).select("point_id", F.col("b.node_id").alias("node"), F.col("b.d").alias("dist_m"), F.lit(1).alias("rank")))
        found = done if found is None else found.unionByName(done)
        left = checkpointed(left.join(done, "point_id", "left_anti"))
        if cell > 360 or not left.limit(1).count():
            break
        cell *= 4
    return points.select("point_id", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("dist_m"), F.lit(1).alias("rank")).limit(0) if found is None else found


class Graph:
    """Directed edges in flat arrays. Nodes are positions in the sorted `nodes`; those of node i are `start[i]` to `start[i + 1]` in `to` and `length`."""

    def __init__(self, u: np.ndarray, v: np.ndarray, length: np.ndarray):
        if len(length) and not length.min() > 0:
            raise ValueError("edge lengths must be positive")
        self.nodes = np.unique(np.concatenate([u, v]))
        u = np.searchsorted(self.nodes, u).astype(np.int32)
        order = np.argsort(u, kind="stable")
        self.start = np.searchsorted(u[order], np.arange(len(self.nodes) + 1))
        self.to = np.searchsorted(self.nodes, v[order]).astype(np.int32)
        self.length = length[order]

    def __getstate__(self):
        return self.nodes, self.start, self.to, self.length

    def __setstate__(self, state):
        self.nodes, self.start, self.to, self.length = state

    def lists(self) -> tuple[list[int], list[int], list[float]]:
        """start, to and length as lists, made once a worker."""
        if not hasattr(self, "_lists"):
            self._lists = self.start.tolist(), self.to.tolist(), self.length.tolist()
        return self._lists

    def position(self, node: int) -> int:
        """-1 for a node without edges."""
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else -1


def sent_graph(edges: DataFrame):
    """The edges (u, v, length) as a broadcast Graph: rows come to the driver as Arrow and never become objects there."""
    t = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "length").toArrow()
    return edges.sparkSession.sparkContext.broadcast(Graph(*(t.column(c).to_numpy() for c in ("u", "v", "length"))))


def shortest(sources: DataFrame, edges: DataFrame, cutoff: float, k: int | None = None) -> DataFrame:
    """Network distances (src, node, dist) from each source (src) along directed edges (u, v, length) up to `cutoff`, the source itself at 0.

    With `k`, only the `k` nearest nodes by distance, then node. The edges of a graph of at most MOST_EDGES are broadcast and
    sources are searched where they are; a larger graph is relaxed by joins, round by round. Non-positive lengths are refused.
    """
    spark = sources.sparkSession
    edges = edges.select("u", "v", F.col("length").cast("double").alias("length")).where("u IS NOT NULL AND v IS NOT NULL AND length IS NOT NULL")
    if edges.count() > MOST_EDGES:
        out = relaxed(sources, edges, cutoff)
        if k is None:
            return out
        return out.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "node"))).where(F.col("_r") <= k).drop("_r")
    sent = sent_graph(edges)

    def search(batches):
        graph = sent.value
        start, to, lengths = graph.lists()
        for b in batches:
            src, node, dist = [], [], []
            for s in b.column(0).to_pylist():
                at = graph.position(s)
                if at < 0:
                    src.append(s)
                    node.append(s)
                    dist.append(0.0)
                    continue
                best, queue, n, first = {at: 0.0}, [(0.0, at)], 0, len(src)
                while queue:
                    d, u = heapq.heappop(queue)
                    if d > best[u]:
                        continue
                    if k is not None and n == k:
                        break
                    n += 1
                    src.append(s)
                    node.append(u)
                    dist.append(d)
                    for i in range(start[u], start[u + 1]):
                        v, e = to[i], d + lengths[i]
                        if e <= cutoff and e < best.get(v, float("inf")):
                            best[v] = e
                            heapq.heappush(queue, (e, v))
                node[first:] = graph.nodes[node[first:]].tolist()
                if len(src) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(node), pa.array(dist)], ["src", "node", "dist"])
                    src, node, dist = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(node, pa.int64()), pa.array(dist, pa.float64())], ["src", "node", "dist"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sources.select(F.col("src").cast("long")).where("src IS NOT NULL").distinct().repartition(parts).mapInArrow(search, "src long, node long, dist double")


def relaxed(sources: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """The same by min-relaxation: only improved (src, node) pairs are extended, and each round is written to the shared folder."""
    known = front = checkpointed(sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist")).distinct())
    while front.limit(1).count():
        step = front.join(edges, front.node == edges.u).select("src", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("dist")).where(F.col("dist") <= cutoff)
        step = step.groupBy("src", "node").agg(F.min("dist").alias("dist"))
        old = known.withColumnRenamed("dist", "_old")
        front = checkpointed(step.join(old, ["src", "node"], "left").where("_old IS NULL OR dist < _old").select("src", "node", "dist"))
        known = checkpointed(known.unionByName(front).groupBy("src", "node").agg(F.min("dist").alias("dist")))
    return known


def nearest_nodes(nodes: DataFrame, edges: DataFrame, k: int = 100, cutoff: float = 5000.0) -> DataFrame:
    """The table (src, node, dist, rank) of the `k` nearest nodes of each node on the network, itself first; by tiles where nodes have places."""
    if {"lat", "lng"} <= set(nodes.columns):
        by_tiles = Network(nodes, edges, k, cutoff)
        if by_tiles.fits:
            return by_tiles.nearest(nodes.select(F.col("node_id").alias("src")).distinct())
    near = shortest(nodes.select(F.col("node_id").alias("src")), edges, cutoff, k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "node")))


def nearest_on_edges(points: DataFrame, nodes: DataFrame, edges: DataFrame, cell: float = 0.002) -> DataFrame:
    """The nearest point of an edge for each point: point_id, u, v (u < v), lat, lng, dist_m on a plane around the point.

    An edge lies in every cell that it crosses and counts whichever way it is stored. A point looks into the 3 x 3 cells around
    its own; where an edge outside of these could be nearer, it looks again into cells four times as wide, as in `snap`. Loops
    and points without coordinates are left out.
    """
    a, b = (nodes.select(F.col("node_id").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lng").alias(f"{c}_lng")).where(f"{c}_lat IS NOT NULL AND {c}_lng IS NOT NULL") for c in "uv")
    segments = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(a, "u").join(b, "v")
    left = points.where("lat IS NOT NULL AND lng IS NOT NULL").select("point_id", "lat", "lng")
    kx, ky = F.cos(F.radians("lat")) * METRES_A_DEGREE, F.lit(METRES_A_DEGREE)
    x = lambda c: (F.col(f"{c}_lng") - F.col("lng")) * kx
    y = lambda c: (F.col(f"{c}_lat") - F.col("lat")) * ky
    dx, dy = x("v") - x("u"), y("v") - y("u")
    on = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x("u") * dx + y("u") * dy) / (dx * dx + dy * dy))))
    ring = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    found = None
    while True:
        at = lambda c: F.floor(c / cell).cast("long")  # noqa: E731, B023
        looks = left.withColumns({"_y": at(F.col("lat")), "_x": at(F.col("lng"))}).withColumn("dy", F.explode(ring)).withColumn("dx", F.explode(ring))
        looks = looks.select("point_id", "lat", "lng", (F.col("_y") + F.col("dy")).alias("cy"), (F.col("_x") + F.col("dx")).alias("cx"))
        near = looks.join(crossed_cells(segments, cell), ["cy", "cx"])
        placed = near.withColumn("t", on).withColumns({"plat": F.col("u_lat") + (F.col("v_lat") - F.col("u_lat")) * F.col("t"), "plng": F.col("u_lng") + (F.col("v_lng") - F.col("u_lng")) * F.col("t")})
        placed = placed.withColumn("dist_m", F.sqrt(((F.col("plng") - F.col("lng")) * kx) ** 2 + ((F.col("plat") - F.col("lat")) * ky) ** 2))
        best = placed.groupBy("point_id").agg(F.min(F.struct(F.round("dist_m", 6).alias("d"), "u", "v", "plat", "plng")).alias("b"), F.first("lat").alias("_at"))
        # whatever lies within one cell's width is in the cells looked into
        sure = F.lit(cell * METRES_A_DEGREE) * F.cos(F.radians("_at"))
        best = checkpointed(best.where(F.lit(cell > 360) | (F.col("b.d") < sure - 1e-5)).drop("_at"))
        found = best if found is None else found.unionByName(best)
        left = left.join(best, "point_id", "left_anti")
        if cell > 360 or not left.limit(1).count():
            break
        cell *= 4
    return found.select("point_id", "b.u", "b.v", F.col("b.plat").alias("lat"), F.col("b.plng").alias("lng"), F.col("b.d").alias("dist_m"))


def crossed_cells(segments: DataFrame, cell: float) -> DataFrame:
    """Segments (u_lat, u_lng, v_lat, v_lng and others), once for each cell (cy, cx) that they cross; rounding may add a cell beside."""
    at = lambda c: F.floor(c / cell).cast("long")
    rows = segments.withColumn("cy", F.explode(F.sequence(at(F.least("u_lat", "v_lat")), at(F.greatest("u_lat", "v_lat")))))
    high = F.col("v_lat") - F.col("u_lat")
    part = lambda edge: F.when(high == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge * cell - F.col("u_lat")) / high)))
    lng = lambda t: F.col("u_lng") + (F.col("v_lng") - F.col("u_lng")) * t
    p = lng(part(F.col("cy")))
    q = F.when(high == 0, F.col("v_lng")).otherwise(lng(part(F.col("cy") + 1)))
    return rows.withColumns({"_p": p, "_q": q}).withColumn("cx", F.explode(F.sequence(at(F.least("_p", "_q") - 1e-9), at(F.greatest("_p", "_q") + 1e-9)))).drop("_p", "_q")


def paths_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, node, dist) of those pairs (src, node) between which there is a path, however long; each source is searched until its nodes are reached."""
    spark = pairs.sparkSession
    edges = edges.select("u", "v", F.col("length").cast("double").alias("length")).where("u IS NOT NULL AND v IS NOT NULL AND length IS NOT NULL")
    pairs = pairs.select(F.col("src").cast("long").alias("src"), F.col("node").cast("long").alias("node")).where("src IS NOT NULL AND node IS NOT NULL").distinct()
    if edges.count() > MOST_EDGES:
        return relaxed(pairs.select("src"), edges, float("inf")).join(pairs, ["src", "node"], "left_semi")
    sent = sent_graph(edges)

    def search(batches):
        graph = sent.value
        start, to, lengths = graph.lists()
        for b in batches:
            src, node, dist = [], [], []
            for s, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s in wanted:
                    src.append(s)
                    node.append(s)
                    dist.append(0.0)
                at = graph.position(s)
                best, queue, left = {at: 0.0}, [(0.0, at)], {graph.position(x) for x in wanted if x != s} - {-1}
                while queue and left and at >= 0:
                    d, u = heapq.heappop(queue)
                    if d > best[u]:
                        continue
                    if u in left:
                        left.remove(u)
                        src.append(s)
                        node.append(int(graph.nodes[u]))
                        dist.append(d)
                    for i in range(start[u], start[u + 1]):
                        v, e = to[i], d + lengths[i]
                        if e < best.get(v, float("inf")):
                            best[v] = e
                            heapq.heappush(queue, (e, v))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(node, pa.int64()), pa.array(dist, pa.float64())], ["src", "node", "dist"])

    return pairs.groupBy("src").agg(F.collect_set("node").alias("nodes")).mapInArrow(search, "src long, node long, dist double")


def walking_distances(requests: DataFrame, nodes: DataFrame, edges: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(user_id, dist_m) from origin to destination: 0 for one place, the great circle for one node or without a path, else the network's distance, unless it is over `cutoff`.

    With a cutoff and placed nodes the trips are searched by tiles, each to its own destination only.
    """
    s = snapped(requests, nodes)
    o, t = (s.where(F.col("side") == side).select("user_id", F.col("node").alias(c)) for side, c in (("orig", "o"), ("dest", "t")))
    both = requests.join(o, "user_id").join(t, "user_id")
    if cutoff is None:
        paths = paths_between(both.select(F.col("o").alias("src"), F.col("t").alias("node")), edges)
    elif (by_tiles := Network(nodes, edges, 1, cutoff)).fits:
        paths = by_tiles.reached(both.select(F.col("o").alias("src"), F.col("t").alias("other")))
    else:
        paths = shortest(o.select(F.col("o").alias("src")), edges, cutoff)
    # the size of a Python step's output isn't known to Spark, so its table is never broadcast
    both = both.join(paths.hint("merge"), (F.col("src") == F.col("o")) & (F.col("node") == F.col("t")), "left")
    ends = [F.col(c) for c in ("origin_lat", "origin_lng", "destination_lat", "destination_lng")]
    same = (F.abs(ends[0] - ends[2]) < 1e-6) & (F.abs(ends[1] - ends[3]) < 1e-6)
    return both.select("user_id", F.when(same, 0.0).when((F.col("o") == F.col("t")) | F.col("dist").isNull(), haversine_m(*ends)).otherwise(F.col("dist")).alias("dist_m"))


def ends(requests: DataFrame) -> DataFrame:
    """(user_id, side, lat, lng): both ends of each request."""
    side = lambda s, c: F.struct(F.lit(s).alias("side"), F.col(f"{c}_lat").alias("lat"), F.col(f"{c}_lng").alias("lng"))
    return requests.select("user_id", F.explode(F.array(side("orig", "origin"), side("dest", "destination"))).alias("e")).select("user_id", "e.*")


def snapped(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(user_id, side, node, dist_m): the node at either end of each request."""
    points = ends(requests).select(F.struct("user_id", "side").alias("point_id"), "lat", "lng")
    return snap(points, nodes).select("point_id.user_id", "point_id.side", "node", "dist_m")


def user_nodes(requests: DataFrame, nodes: DataFrame, knn: DataFrame) -> DataFrame:
    """(user_id, side, node, dist): the nodes near either end of each request."""
    at = snapped(requests, nodes).select("user_id", "side", F.col("node").alias("src"))
    return at.join(knn, "src").select("user_id", "side", "node", "dist")
