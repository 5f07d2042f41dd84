"""Ride tables derived from the driver's tables, as DataFrames; SQL has the same for DuckDB (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT0, LNG0, STEP, FINE, SHIFT = 35.90, 50.70, 0.001, 1e-5, 3.7e-6
CUTOFF_M, KNN_CUTOFF_M = 1000.0, 1500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_rows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").count() // 50


def road_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 50).alias("gx"), F.expr("p_partkey div 50").alias("gy"))
    return p.select("node_id", (F.lit(LAT0) + F.col("gy") * STEP).alias("lat"), (F.lit(LNG0) + F.col("gx") * STEP).alias("lng"), "gx", "gy")


def road_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid_rows(spark, sf_dir)
    n = road_node(spark, sf_dir)
    right = n.where("gx < 49").select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"), (F.col("node_id") * 37 % 41 + 80).cast("double").alias("length"))
    up = n.where(F.col("gy") < rows - 1).select(F.col("node_id").alias("u"), (F.col("node_id") + 50).alias("v"), (F.col("node_id") * 53 % 43 + 80).cast("double").alias("length"))
    one = right.union(up)
    return one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))


def ride_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = 100 * grid_rows(spark, sf_dir) - 100
    k = F.col("c_custkey")
    at = lambda base, times, mod: (F.lit(base) + (k * times % mod) * F.lit(FINE) + F.lit(SHIFT))
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), at(LAT0, 7919, m).alias("origin_lat"), at(LNG0, 104729, 4900).alias("origin_lng"), at(LAT0, 1299709, m).alias("destination_lat"), at(LNG0, 15485863, 4900).alias("destination_lng"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey * 13 % 1440 as int), 0)").alias("stored_at"), F.lit("pending").alias("status"), F.col("c_nationkey").alias("nation"),
    )


def ride_intercity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests between cities: adds origin_city (null for some) and passengers."""
    return ride_request(spark, sf_dir).withColumns({"origin_city": F.when(F.col("user_id") % 97 != 0, F.col("nation").cast("string")), "passengers": (F.col("user_id") % 3 + 1).cast("int")})


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pts): 5 to 11 points on the straight line from origin to destination."""
    r = ride_request(spark, sf_dir).withColumn("n", (F.col("user_id") % 7 + 5).cast("int"))
    point = lambda i: F.struct(*((F.col(f"origin_{c}") + (F.col(f"destination_{c}") - F.col(f"origin_{c}")) * i.cast("double") / (F.col("n") - 1)).alias(c) for c in ("lat", "lng")))
    return r.select("user_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), point).alias("pts"))


def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.when(k % 11 == 0, -1).otherwise(k % 50).cast("int").alias("label"))


def ride_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, user_id, created_at): every seventh request has no group, the others form groups of up to three by id."""
    r = ride_request(spark, sf_dir).where("user_id % 7 <> 0")
    return r.select(F.expr("user_id div 3").alias("group_id"), "user_id", "stored_at", "origin_lat", "origin_lng", "destination_lat", "destination_lng")


def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        k.alias("nation"), F.when(k % 4 == 0, "").otherwise(F.col("n_name")).alias("city"), F.when(k % 3 != 0, F.concat("n_name", F.lit(" Town"))).alias("town"), F.concat("n_name", F.lit(" Village")).alias("village"),
        F.col("r_name").alias("county"), F.when(k % 5 != 0, F.concat("r_name", F.lit(" State"))).alias("state"),
    )


def location_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = 100 * grid_rows(spark, sf_dir) - 100
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "update").otherwise("add")
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("seq"), op.alias("op"), "user_id", "ts", (F.lit(LAT0) + (k * 7919 % m) * F.lit(FINE)).alias("lat"), (F.lit(LNG0) + (k * 104729 % 4900) * F.lit(FINE)).alias("lng")
    )


D = "::DOUBLE"
_AT = lambda base, times, mod: f"({base}{D} + (c_custkey * {times} % {mod}) * 1e-5{D} + 3.7e-6{D})"
_M = "(SELECT 100 * (count(*) // 50) - 100 FROM part)"
SQL = f"""WITH RECURSIVE
road_node AS (SELECT p_partkey AS node_id, 35.90{D} + (p_partkey // 50) * 0.001{D} AS lat, 50.70{D} + (p_partkey % 50) * 0.001{D} AS lng, p_partkey % 50 AS gx, p_partkey // 50 AS gy FROM part),
one_way AS (SELECT node_id AS u, node_id + 1 AS v, (node_id * 37 % 41 + 80){D} AS length FROM road_node WHERE gx < 49
  UNION ALL SELECT node_id, node_id + 50, (node_id * 53 % 43 + 80){D} FROM road_node WHERE gy < (SELECT max(gy) FROM road_node)),
road_edge AS (SELECT u, v, length FROM one_way UNION ALL SELECT v, u, length FROM one_way),
ride_request AS (SELECT c_custkey AS user_id, {_AT(35.90, 7919, _M)} AS origin_lat, {_AT(50.70, 104729, 4900)} AS origin_lng, {_AT(35.90, 1299709, _M)} AS destination_lat, {_AT(50.70, 15485863, 4900)} AS destination_lng,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey * 13 % 1440) AS stored_at, 'pending' AS status, c_nationkey AS nation FROM customer),
ride_intercity AS (SELECT *, CASE WHEN user_id % 97 <> 0 THEN nation::VARCHAR END AS origin_city, (user_id % 3 + 1)::INT AS passengers FROM ride_request),
route_point AS (SELECT user_id, i, n, origin_lat + (destination_lat - origin_lat) * i{D} / (n - 1) AS lat, origin_lng + (destination_lng - origin_lng) * i{D} / (n - 1) AS lng
  FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, (user_id % 7 + 5)::INT AS n FROM ride_request))),
cluster_assign AS (SELECT c_custkey AS user_id, (CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey % 50 END)::INT AS label FROM customer),
ride_group AS (SELECT user_id // 3 AS group_id, user_id, stored_at, origin_lat, origin_lng, destination_lat, destination_lng FROM ride_request WHERE user_id % 7 <> 0),
place AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS city, CASE WHEN n_nationkey % 3 <> 0 THEN n_name || ' Town' END AS town, n_name || ' Village' AS village, r_name AS county, CASE WHEN n_nationkey % 5 <> 0 THEN r_name || ' State' END AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
location_event AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'update' ELSE 'add' END AS op, user_id, ts, 35.90{D} + (event_id * 7919 % {_M}) * 1e-5{D} AS lat, 50.70{D} + (event_id * 104729 % 4900) * 1e-5{D} AS lng FROM events),
sssp(src, node, dist) USING KEY (src, node) AS (SELECT node_id, node_id, 0{D} FROM road_node UNION
  (SELECT s.src, e.v, min(s.dist + e.length) FROM sssp s JOIN road_edge e ON e.u = s.node LEFT JOIN recurring.sssp r ON r.src = s.src AND r.node = e.v WHERE s.dist + e.length <= {KNN_CUTOFF_M} AND (r.dist IS NULL OR s.dist + e.length < r.dist) GROUP BY s.src, e.v)),
knn200 AS (SELECT src, node, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, node) AS rank FROM sssp) WHERE rank <= 200),
knn AS (SELECT * FROM knn200 WHERE rank <= 100),
ends AS (SELECT user_id, 'orig' AS side, origin_lat AS lat, origin_lng AS lng FROM ride_request UNION ALL SELECT user_id, 'dest', destination_lat, destination_lng FROM ride_request),
snap AS (SELECT user_id, side, arg_min(node_id, (d, node_id)) AS node, min(d) AS dist_m FROM (SELECT e.user_id, e.side, n.node_id, 2 * 6371000{D} * asin(least(1{D}, sqrt(sin(radians(n.lat - e.lat) / 2) ** 2 + cos(radians(e.lat)) * cos(radians(n.lat)) * sin(radians(n.lng - e.lng) / 2) ** 2))) AS d
  FROM ends e JOIN road_node n ON abs(n.lat - e.lat) <= 0.002{D} AND abs(n.lng - e.lng) <= 0.002{D}) GROUP BY user_id, side),
user_knn AS (SELECT s.user_id, s.side, k.node, k.dist FROM snap s JOIN knn k ON k.src = s.node),
mpb_side AS (SELECT a.user_id, b.user_id AS cand_id, a.side, count(*) AS shared, min(sqrt(a.dist * a.dist + b.dist * b.dist) / 2) AS score, arg_min(a.node, (sqrt(a.dist * a.dist + b.dist * b.dist) / 2, a.node)) AS node
  FROM user_knn a JOIN user_knn b ON a.side = b.side AND a.node = b.node AND a.user_id > b.user_id GROUP BY a.user_id, b.user_id, a.side),
mpb_pair AS (SELECT o.user_id, o.cand_id, o.shared AS n_orig, d.shared AS n_dest, o.score AS orig_score, d.score AS dest_score, o.node AS orig_node, d.node AS dest_node, o.score + d.score AS total
  FROM mpb_side o JOIN mpb_side d ON o.user_id = d.user_id AND o.cand_id = d.cand_id WHERE o.side = 'orig' AND d.side = 'dest')
"""
