"""Queries on the street network and on matching by meeting points, MinHash and cosine."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import bucketing, cosine, lsh
from wayfold.operators import network as net
from wayfold.operators.tiles import Network
from wayfold.plans.base import query
from wayfold.sources import fixtures as fx

R = lambda c, n=6: F.round(c, n).alias(c if isinstance(c, str) else None)


def knn(spark, d, k=100):
    return net.nearest_nodes(fx.road_node(spark, d), fx.road_edge(spark, d), k, fx.KNN_CUTOFF_M)


def tiled(spark, d, k=100):
    """The street network by tiles; the ride tables' nodes have places, so it fits."""
    out = Network(fx.road_node(spark, d), fx.road_edge(spark, d), k, fx.KNN_CUTOFF_M)
    if not out.fits:
        raise ValueError("the network has nodes without places, or none at all")
    return out


def snapped(spark, d):
    """Both ends of each request: user_id, side, node and dist_m."""
    return net.snapped(fx.ride_request(spark, d), fx.road_node(spark, d))


def near(spark, d):
    return tiled(spark, d).nearest(snapped(spark, d).select("user_id", "side", F.col("node").alias("src")), ranked=False).drop("src")


def meeting_pairs(spark, d):
    """Pairs by meeting points, and the riders that they are of."""
    network = tiled(spark, d)
    who = net.checkpointed(bucketing.riders(snapped(spark, d), network))
    return bucketing.network_pairs(net.checkpointed(bucketing.candidates(who)), network), who, network


@query("SELECT u, v, length, a.lat AS u_lat, a.lng AS u_lng FROM road_edge JOIN road_node a ON a.node_id = u")
def scan_graph(spark, d):
    n = fx.road_node(spark, d)
    return fx.road_edge(spark, d).join(n, F.col("u") == n.node_id).select("u", "v", "length", F.col("lat").alias("u_lat"), F.col("lng").alias("u_lng"))


@query("SELECT user_id, side, node, round(dist_m, 6) AS dist_m FROM snap")
def snap_nearest_node(spark, d):
    return net.snapped(fx.ride_request(spark, d), fx.road_node(spark, d)).select("user_id", "side", "node", R("dist_m"))


_HAV_M = "2 * 6371000::DOUBLE * asin(least(1::DOUBLE, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lng - {a}.lng) / 2) ** 2)))"


@query(f"""SELECT user_id, node, round(d, 6) AS dist_m, rank FROM (SELECT user_id, node_id AS node, d, row_number() OVER (PARTITION BY user_id ORDER BY d, node_id) AS rank
 FROM (SELECT e.user_id, n.node_id, {_HAV_M.format(a='e', b='n')} AS d FROM ends e JOIN road_node n ON abs(n.lat - e.lat) <= 0.01::DOUBLE AND abs(n.lng - e.lng) <= 0.01::DOUBLE WHERE e.side = 'orig')) WHERE rank <= 5""")
def knn_spatial(spark, d):
    p = fx.ride_request(spark, d).select(F.col("user_id").alias("point_id"), F.col("origin_lat").alias("lat"), F.col("origin_lng").alias("lng"))
    return net.snap(p, fx.road_node(spark, d), k=5).select(F.col("point_id").alias("user_id"), "node", R("dist_m"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT user_id, u, v, round(plat, 9) AS lat, round(plng, 9) AS lng, d AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, u, v) AS r FROM (
 SELECT user_id, u, v, ulat + (vlat - ulat) * t AS plat, ulng + (vlng - ulng) * t AS plng, round(sqrt(((ulng + (vlng - ulng) * t - lng) * kx) ** 2 + ((ulat + (vlat - ulat) * t - lat) * 111194::DOUBLE) ** 2), 6) AS d FROM (
 SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, -(xu * (xv - xu) + yu * (yv - yu)) / ((xv - xu) * (xv - xu) + (yv - yu) * (yv - yu)))) AS t FROM (
 SELECT e.user_id, e.lat, e.lng, s.u, s.v, a.lat AS ulat, a.lng AS ulng, b.lat AS vlat, b.lng AS vlng, cos(radians(e.lat)) * 111194::DOUBLE AS kx,
  (a.lng - e.lng) * (cos(radians(e.lat)) * 111194::DOUBLE) AS xu, (b.lng - e.lng) * (cos(radians(e.lat)) * 111194::DOUBLE) AS xv, (a.lat - e.lat) * 111194::DOUBLE AS yu, (b.lat - e.lat) * 111194::DOUBLE AS yv
 FROM one_way s JOIN road_node a ON a.node_id = s.u JOIN road_node b ON b.node_id = s.v JOIN ends e ON e.side = 'orig' AND abs(a.lat - e.lat) <= 0.003::DOUBLE AND abs(a.lng - e.lng) <= 0.003::DOUBLE)))) WHERE r = 1""")
def snap_nearest_edge(spark, d):
    p = fx.ride_request(spark, d).select(F.col("user_id").alias("point_id"), F.col("origin_lat").alias("lat"), F.col("origin_lng").alias("lng"))
    out = net.nearest_on_edges(p, fx.road_node(spark, d), fx.road_edge(spark, d))
    return out.select(F.col("point_id").alias("user_id"), "u", "v", R("lat", 9), R("lng", 9), "dist_m")


@query(f"SELECT src, node, dist FROM sssp WHERE dist <= {fx.CUTOFF_M}")
def network_sssp(spark, d):
    return net.shortest(fx.road_node(spark, d).select(F.col("node_id").alias("src")), fx.road_edge(spark, d), fx.CUTOFF_M)


@query("SELECT src, node, dist, rank FROM knn")
def network_knn(spark, d):
    return knn(spark, d).select("src", "node", "dist", F.col("rank").cast("long").alias("rank"))


@query("SELECT node_id FROM road_node WHERE node_id NOT IN (SELECT src FROM knn WHERE src % 3 = 0)")
def knn_resume_remaining(spark, d):
    """The nodes that a run still has to process when those divisible by three are done."""
    n = fx.road_node(spark, d)
    done = net.shortest(n.where("node_id % 3 = 0").select(F.col("node_id").alias("src")), fx.road_edge(spark, d), fx.CUTOFF_M, 1)
    return n.join(done, n.node_id == done.src, "left_anti").select("node_id")


@query(f"""SELECT user_id, round(CASE WHEN same THEN 0 WHEN o = t OR dist IS NULL THEN gc ELSE dist END, 6) AS dist_m FROM (SELECT r.user_id, abs(origin_lat - destination_lat) < 1e-6 AND abs(origin_lng - destination_lng) < 1e-6 AS same, o.node AS o, t.node AS t, k.dist,
 {_HAV_M.format(a='a', b='b')} AS gc FROM ride_request r JOIN snap o ON o.user_id = r.user_id AND o.side = 'orig' JOIN snap t ON t.user_id = r.user_id AND t.side = 'dest'
 JOIN ends a ON a.user_id = r.user_id AND a.side = 'orig' JOIN ends b ON b.user_id = r.user_id AND b.side = 'dest' LEFT JOIN sssp k ON k.src = o.node AND k.node = t.node)""")
def walking_distance(spark, d):
    """From origin to destination: the network's distance where it is within the cutoff of the SQL, else the great circle."""
    return net.walking_distances(fx.ride_request(spark, d), fx.road_node(spark, d), fx.road_edge(spark, d), fx.KNN_CUTOFF_M).select("user_id", R("dist_m"))


@query("SELECT user_id, cand_id, n_orig, n_dest FROM mpb_pair")
def mpb_candidates(spark, d):
    return meeting_pairs(spark, d)[0].select("user_id", "cand_id", "n_orig", "n_dest")


@query("SELECT user_id, cand_id, side, shared, round(score, 6) AS score FROM mpb_side")
def mpb_side_score(spark, d):
    at = snapped(spark, d).select("user_id", "side", F.col("node").alias("src"))
    return tiled(spark, d).partners(at).select("user_id", "cand_id", "side", "shared", R("score"))


@query("SELECT user_id, cand_id, round(total, 6) AS total, round(exp(-total / 1000), 6) AS decay FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total, cand_id) AS r FROM mpb_pair WHERE total <= 693.1471805599453::DOUBLE) WHERE r = 1")
def mpb_pair_score(spark, d):
    """Each rider's best earlier partner."""
    best = bucketing.best_partner(meeting_pairs(spark, d)[0])
    return best.select("user_id", "cand_id", R("total"), F.round(F.exp(-F.col("total") / 1000), 6).alias("decay"))


@query("""SELECT p.user_id, p.cand_id, o.lat AS origin_lat, o.lng AS origin_lng, t.lat AS destination_lat, t.lng AS destination_lng FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total, cand_id) AS r FROM mpb_pair WHERE total <= 693.1471805599453::DOUBLE) p
 JOIN road_node o ON o.node_id = p.orig_node JOIN road_node t ON t.node_id = p.dest_node WHERE r = 1""")
def mpb_meeting_points(spark, d):
    best = bucketing.best_partner(meeting_pairs(spark, d)[0])
    at = lambda key, name: fx.road_node(spark, d).select(F.col("node_id").alias(key), F.col("lat").alias(f"{name}_lat"), F.col("lng").alias(f"{name}_lng"))
    return best.join(at("orig_node", "origin"), "orig_node").join(at("dest_node", "destination"), "dest_node").select("user_id", "cand_id", "origin_lat", "origin_lng", "destination_lat", "destination_lng")


_BUCKETS = """SELECT p.user_id, p.cand_id, a.side, a.node, round(sqrt(a.dist * a.dist + b.dist * b.dist){half}, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total, cand_id) AS r FROM mpb_pair WHERE total <= 693.1471805599453::DOUBLE) p
 JOIN user_knn a ON a.user_id = p.user_id JOIN user_knn b ON b.user_id = p.cand_id AND b.side = a.side AND b.node = a.node WHERE p.r = 1"""


def _group_buckets(spark, d, half: bool):
    scored, who, network = meeting_pairs(spark, d)
    end = lambda key, name: who.select(F.col("user_id").alias(key), F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias(name)) for side, c in (("orig", "o"), ("dest", "d")))).alias("ends")).select(key, F.inline("ends"))
    best = bucketing.best_partner(scored).select("user_id", "cand_id").join(end("user_id", "src"), "user_id").join(end("cand_id", "other"), ["cand_id", "side"])
    dist = F.sqrt(F.col("dist") * F.col("dist") + F.col("other_dist") * F.col("other_dist"))
    return network.shared(best).select("user_id", "cand_id", "side", "node", F.round(dist / 2 if half else dist, 6).alias("dist"))


@query(_BUCKETS.format(half=""))
def mpb_group_buckets(spark, d):
    return _group_buckets(spark, d, False)


@query(_BUCKETS.format(half=" / 2"))
def mpb_rebuild_buckets(spark, d):
    return _group_buckets(spark, d, True)


@query("SELECT a.user_id, b.user_id AS cand_id, a.side, count(*) AS common FROM user_knn a JOIN user_knn b ON a.side = b.side AND a.node = b.node AND b.user_id = a.user_id - 1 GROUP BY ALL")
def common_buckets(spark, d):
    at = snapped(spark, d).select("user_id", "side", F.col("node").alias("src"))
    before = at.select((F.col("user_id") + 1).alias("user_id"), "side", F.col("src").alias("other"))
    both = tiled(spark, d).meet(at.join(before, ["user_id", "side"]))
    return both.select("user_id", (F.col("user_id") - 1).alias("cand_id"), "side", F.col("shared").alias("common"))


# -- MinHash

_COEF = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(lsh.coefficients()))
LSH_SQL = fx.SQL + f""", coef(i, a, b) AS (VALUES {_COEF}),
sig AS (SELECT src, i, min((a * node::BIGINT + b) % {lsh.PRIME} % {lsh.RANGE}) AS h FROM knn200 CROSS JOIN coef GROUP BY src, i),
sigs AS (SELECT src, list(h ORDER BY i) AS signature FROM sig GROUP BY src),
user_sig AS (SELECT o.user_id, a.signature AS os, b.signature AS ds FROM snap o JOIN snap t ON t.user_id = o.user_id AND t.side = 'dest' JOIN sigs a ON a.src = o.node JOIN sigs b ON b.src = t.node WHERE o.side = 'orig'),
user_bucket AS (SELECT user_id, i, (os[i + 1] + ds[i + 1]) % {lsh.RANGE} AS bucket FROM user_sig CROSS JOIN range(15) t(i)),
cand AS (SELECT a.user_id, b.user_id AS cand_id, count(*) AS n_buckets FROM (SELECT DISTINCT user_id, bucket FROM user_bucket) a JOIN (SELECT DISTINCT user_id, bucket FROM user_bucket) b ON a.bucket = b.bucket AND a.user_id > b.user_id GROUP BY ALL),
sim AS (SELECT c.user_id, c.cand_id, o.dist + t.dist AS total, CASE WHEN o.dist + t.dist IS NULL THEN -1 WHEN o.dist + t.dist = 0 THEN 1 ELSE exp(-(o.dist + t.dist) / 1000) END AS sim FROM cand c
 JOIN snap uo ON uo.user_id = c.user_id AND uo.side = 'orig' JOIN snap ut ON ut.user_id = c.user_id AND ut.side = 'dest' JOIN snap co ON co.user_id = c.cand_id AND co.side = 'orig' JOIN snap ct ON ct.user_id = c.cand_id AND ct.side = 'dest'
 LEFT JOIN knn200 o ON o.src = co.node AND o.node = uo.node LEFT JOIN knn200 t ON t.src = ct.node AND t.node = ut.node)
"""


def _lsh(spark, d, hashes=lsh.hashes):
    """The network, both ends of each request, and the signatures of either end's nearest nodes."""
    network, at = tiled(spark, d, 200), net.checkpointed(snapped(spark, d))
    signed = network.least(at.select("user_id", "side", F.col("node").alias("src")), hashes, "signature")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("signature")))
    banded = signed.groupBy("user_id").agg(of("orig").alias("os"), of("dest").alias("ds")).where("os IS NOT NULL AND ds IS NOT NULL")
    return network, at, banded


@query(LSH_SQL + f"SELECT node_id AS node, i, (a * node_id::BIGINT + b) % {lsh.PRIME} % {lsh.RANGE} AS h FROM road_node CROSS JOIN coef")
def minhash_hash(spark, d):
    each = F.array(*(F.struct(F.lit(i).alias("i"), lsh.hash_of(F.col("node_id"), a, b).alias("h")) for i, (a, b) in enumerate(lsh.coefficients())))
    return fx.road_node(spark, d).select(F.col("node_id").alias("node"), F.explode(each).alias("e")).select("node", "e.i", "e.h")


@query(LSH_SQL + "SELECT src, array_to_string(signature, ',') AS signature FROM sigs")
def minhash_signature(spark, d):
    return tiled(spark, d, 200).least(fx.road_node(spark, d).select(F.col("node_id").alias("src")), lsh.hashes, "signature").select("src", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(LSH_SQL + "SELECT user_id, array_to_string(flatten([[os[i], ds[i]] FOR i IN range(1, 31)]), ',') AS merged FROM user_sig")
def signature_merge(spark, d):
    return _lsh(spark, d)[2].select("user_id", F.array_join(lsh.merged(F.col("os"), F.col("ds")).cast("array<string>"), ",").alias("merged"))


@query(LSH_SQL + "SELECT user_id, array_to_string(list(bucket ORDER BY i), ',') AS buckets FROM user_bucket GROUP BY user_id")
def lsh_buckets(spark, d):
    return _lsh(spark, d, lsh.banded_hashes)[2].select("user_id", F.array_join(lsh.bands(lsh.merged(F.col("os"), F.col("ds"))).cast("array<string>"), ",").alias("buckets"))


def _lsh_candidates(spark, d):
    network, at, banded = _lsh(spark, d, lsh.banded_hashes)
    return network, at, lsh.candidates(banded.select("user_id", lsh.bands(lsh.merged(F.col("os"), F.col("ds"))).alias("buckets")))


@query(LSH_SQL + "SELECT user_id, cand_id, n_buckets FROM cand")
def lsh_candidates(spark, d):
    return _lsh_candidates(spark, d)[2]


@query(LSH_SQL + "SELECT user_id, cand_id, total, round(sim, 6) AS sim FROM sim")
def lsh_similarity(spark, d):
    network, at, cand = _lsh_candidates(spark, d)
    return lsh.network_similarity(cand.select("user_id", "cand_id"), at, network).select("user_id", "cand_id", "total", R("sim"))


@query(LSH_SQL + "SELECT user_id, cand_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, cand_id) AS rank FROM sim WHERE sim >= 0.5) WHERE rank <= 2")
def lsh_top2(spark, d):
    network, at, cand = _lsh_candidates(spark, d)
    return lsh.top_two(lsh.network_similarity(cand.select("user_id", "cand_id"), at, network)).select("user_id", "cand_id", R("sim"), F.col("rank").cast("long").alias("rank"))


# -- cosine

_FEAT = fx.SQL + ", feat AS (SELECT user_id, node + CASE side WHEN 'dest' THEN (SELECT count(*) FROM road_node) ELSE 0 END AS dim, exp(-dist * dist / 500000) AS w FROM user_knn)\n"


def _features(spark, d):
    return cosine.features(near(spark, d), fx.road_node(spark, d).count())


def _cosines(spark, d):
    network = tiled(spark, d)
    return cosine.network_pairs(net.checkpointed(bucketing.riders(snapped(spark, d), network)), network)


@query("SELECT src, node, round(exp(-dist * dist / 500000), 6) AS w FROM knn")
def gaussian_weight(spark, d):
    from wayfold.functions.geo import gaussian_weight as weight

    return knn(spark, d).select("src", "node", F.round(weight(F.col("dist")), 6).alias("w"))


@query(_FEAT + "SELECT user_id, dim, round(w, 6) AS w FROM feat")
def mips_features(spark, d):
    return _features(spark, d).select("user_id", "dim", R("w"))


@query(_FEAT + ", unit AS (SELECT user_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM feat) SELECT a.user_id, b.user_id AS cand_id, round(sum(a.w * b.w), 6) AS cos FROM unit a JOIN unit b ON a.dim = b.dim AND a.user_id > b.user_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.7")
def mips_pairs(spark, d):
    return _cosines(spark, d).select("user_id", "cand_id", R("cos"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cos FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.35")
def embedding_cosine_pairs(spark, d):
    return cosine.dense_pairs(fx.table(spark, d, "embeddings"), 0.35).select("a", "b", R("cos"))
