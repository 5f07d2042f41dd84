"""Queries on clusters, groups, storage and everything relational."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import clusters as cl
from wayfold.operators import intercity as ic
from wayfold.operators import storage as st
from wayfold.plans.base import query
from wayfold.sources import fixtures as fx

D = "::DOUBLE"
HAV = "2 * 6371000::DOUBLE * asin(least(1::DOUBLE, sqrt(sin(radians({b}lat - {a}lat) / 2) ** 2 + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lng - {a}lng) / 2) ** 2)))"
KM = "12742::DOUBLE * atan2(sqrt({x}), sqrt(1 - ({x})))"
ANGLE = "sin(radians({b}_lat - {a}_lat) / 2) ** 2 + cos(radians({a}_lat)) * cos(radians({b}_lat)) * sin(radians({b}_lng - {a}_lng) / 2) ** 2"
M_SQL = fx.SQL + f""", m AS (SELECT e.user_id, c.label, e.side, e.lat, e.lng FROM ends e JOIN cluster_assign c USING (user_id) WHERE c.label >= 0),
pair AS (SELECT a.label, a.side, a.user_id, b.user_id AS other, {HAV.format(a='a.', b='b.')} AS d FROM m a JOIN m b ON a.label = b.label AND a.side = b.side AND a.user_id <> b.user_id),
msum AS (SELECT m.label, m.side, m.user_id, m.lat, m.lng, round(coalesce(s, 0), 6) AS s FROM m LEFT JOIN (SELECT label, side, user_id, sum(d) AS s FROM pair GROUP BY ALL) p USING (label, side, user_id)),
medoid AS (SELECT label, side, user_id, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY label, side ORDER BY s, user_id) AS r FROM msum) WHERE r = 1),
centred AS (SELECT m.label, m.side, m.user_id, {HAV.format(a='m.', b='c.')} AS d FROM m JOIN medoid c ON c.label = m.label AND c.side = m.side),
sse AS (SELECT side, sum(d * d) AS sse FROM centred GROUP BY side),
wide AS (SELECT l.label, l.side, coalesce(p.mean, 0) AS mean FROM (SELECT DISTINCT label, side FROM m) l LEFT JOIN (SELECT label, side, avg(d) AS mean FROM pair GROUP BY ALL) p USING (label, side)),
intra AS (SELECT side, avg(mean) AS intra, max(mean) AS widest FROM wide GROUP BY side),
far AS (SELECT a.side, a.label, a.user_id, b.label AS l2, avg({HAV.format(a='a.', b='b.')}) AS d FROM m a JOIN m b ON a.side = b.side AND a.user_id <> b.user_id GROUP BY a.side, a.label, a.user_id, b.label),
sil AS (SELECT side, avg(CASE WHEN b IS NULL THEN -1 WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT side, user_id, max(CASE WHEN label = l2 THEN d END) AS a, min(CASE WHEN label <> l2 THEN d END) AS b FROM far GROUP BY ALL) GROUP BY side),
inter AS (SELECT a.label AS i, b.label AS j, {HAV.format(a='a.', b='b.')} AS d FROM medoid a JOIN medoid b ON a.label < b.label AND a.side = b.side WHERE a.side = 'orig'),
dunn AS (SELECT CASE WHEN least IS NULL THEN 0 WHEN coalesce(widest, 0) = 0 THEN 'infinity'::DOUBLE ELSE least / widest END AS dunn FROM (SELECT min(d) AS least FROM inter), (SELECT max(widest) AS widest FROM intra WHERE side = 'orig'))
"""
R = lambda c, n=6: F.round(c, n).alias(c)


def members(spark, d):
    return cl.members(fx.ride_request(spark, d), fx.cluster_assign(spark, d))


@query(M_SQL + "SELECT side, round(sse, 3) AS sse FROM sse")
def cluster_sse(spark, d):
    m = members(spark, d)
    return cl.squared_error(cl.to_centre(m, cl.medoids(m))).select("side", R("sse", 3))


@query(M_SQL + "SELECT side, round(intra, 6) AS intra FROM intra")
def intra_cluster(spark, d):
    return cl.intra(members(spark, d)).select("side", R("intra"))


@query(M_SQL + "SELECT side, round(max(most), 6) AS max_radius, round(avg(mean), 6) AS avg_radius FROM (SELECT side, label, max(d) AS most, avg(d) AS mean FROM centred GROUP BY ALL) GROUP BY side")
def cluster_radii(spark, d):
    m = members(spark, d)
    return cl.radii(cl.to_centre(m, cl.medoids(m))).select("side", R("max_radius"), R("avg_radius"))


@query(M_SQL + "SELECT side, round(silhouette, 6) AS silhouette FROM sil")
def silhouette(spark, d):
    return cl.silhouettes(members(spark, d)).select("side", R("silhouette"))


@query(M_SQL + "SELECT label, side, user_id FROM medoid")
def cluster_medoid(spark, d):
    return cl.medoids(members(spark, d)).select("label", "side", "user_id")


@query(M_SQL + "SELECT m.label, m.side, CASE WHEN m.label % 2 = 0 THEN (-m.label)::BIGINT ELSE m.user_id END AS centre_id, round(CASE WHEN m.label % 2 = 0 THEN a.lat ELSE m.lat END, 9) AS lat, round(CASE WHEN m.label % 2 = 0 THEN a.lng ELSE m.lng END, 9) AS lng FROM medoid m JOIN (SELECT label, side, avg(lat) AS lat, avg(lng) AS lng FROM m GROUP BY ALL) a USING (label, side)")
def cluster_centroid(spark, d):
    """The given meeting point where there is one (here the mean, for even labels; its id is minus the label), else the medoid."""
    m = members(spark, d)
    given = cl.means(m).where("label % 2 = 0").select("label", "side", F.col("lat").alias("glat"), F.col("lng").alias("glng"))
    both = cl.medoids(m).join(given, ["label", "side"], "left")
    return both.select("label", "side", F.when(F.col("glat").isNotNull(), -F.col("label").cast("long")).otherwise(F.col("user_id")).alias("centre_id"), F.round(F.coalesce("glat", "lat"), 9).alias("lat"), F.round(F.coalesce("glng", "lng"), 9).alias("lng"))


@query(M_SQL + "SELECT label, side, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng FROM m GROUP BY ALL")
def mean_centroid(spark, d):
    return cl.means(members(spark, d)).select("label", "side", R("lat", 9), R("lng", 9))


@query(M_SQL + "SELECT label, side, round(median(lat), 9) AS lat, round(median(lng), 9) AS lng FROM m GROUP BY ALL")
def median_centroid(spark, d):
    return members(spark, d).groupBy("label", "side").agg(F.round(F.median("lat"), 9).alias("lat"), F.round(F.median("lng"), 9).alias("lng"))


@query(M_SQL + f", c AS (SELECT label, side, median(lat) AS lat, median(lng) AS lng FROM m GROUP BY ALL) SELECT label, side, user_id FROM (SELECT m.label, m.side, m.user_id, row_number() OVER (PARTITION BY m.label, m.side ORDER BY round({HAV.format(a='m.', b='c.')}, 6), m.user_id) AS r FROM m JOIN c ON c.label = m.label AND c.side = m.side) WHERE r = 1")
def closest_member(spark, d):
    m = members(spark, d)
    dist = cl.to_centre(m, m.groupBy("label", "side").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng")))
    return dist.groupBy("label", "side").agg(F.min(F.struct(F.round("d", 6).alias("d"), "user_id")).alias("b")).select("label", "side", "b.user_id")


@query(M_SQL + "SELECT i, j, round(d, 6) AS d FROM inter")
def inter_cluster(spark, d):
    return cl.between(cl.medoids(members(spark, d))).select("i", "j", R("d"))


@query(M_SQL + "SELECT round(dunn, 6) AS dunn FROM dunn")
def dunn_index(spark, d):
    m = members(spark, d)
    return cl.dunn(m, cl.medoids(m)).select(R("dunn"))


@query(M_SQL + """SELECT round((SELECT sum(sse) FROM sse), 3) AS sse, round((SELECT sum(intra) FROM intra), 6) AS intra, round((SELECT avg(silhouette) FROM sil), 6) AS silhouette,
 (SELECT count(DISTINCT label) FROM m) AS n_clusters, round((SELECT avg(n) FROM (SELECT count(*) AS n FROM m WHERE side = 'orig' GROUP BY label)), 6) AS avg_size, round((SELECT dunn FROM dunn), 6) AS dunn""")
def cluster_evaluation(spark, d):
    return cl.evaluation(members(spark, d)).select(R("sse", 3), R("intra"), R("silhouette"), "n_clusters", R("avg_size"), R("dunn"))


@query(M_SQL + "SELECT label, user_id, other, round(d, 6) AS d FROM pair WHERE side = 'orig' UNION ALL SELECT label, user_id, user_id, 0 FROM m WHERE side = 'orig'")
def distance_matrix(spark, d):
    """Origin distances within clusters, symmetric, with a zero diagonal."""
    m = members(spark, d).where("side = 'orig'")
    return cl.within(m).select("label", "user_id", "other", R("d")).union(m.select("label", "user_id", F.col("user_id"), F.lit(0.0)))


@query("SELECT r.user_id, coalesce(c.label, -1)::INT AS label FROM ride_request r LEFT JOIN (SELECT * FROM cluster_assign WHERE label % 5 <> 0) c USING (user_id)")
def cluster_labels(spark, d):
    c = fx.cluster_assign(spark, d).where("label % 5 <> 0").groupBy("user_id").agg(F.max("label").alias("label"))
    return fx.ride_request(spark, d).select("user_id").join(c, "user_id", "left").select("user_id", F.coalesce("label", F.lit(-1)).alias("label"))


@query("SELECT label, count(*) AS n, avg(count(*)) OVER () AS avg_size FROM cluster_assign WHERE label >= 0 GROUP BY label")
def cluster_sizes(spark, d):
    n = fx.cluster_assign(spark, d).where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("avg_size"))))


@query("SELECT count(*) AS clusters, count(*) FILTER (n > 1) AS shared, sum(n)::BIGINT AS users FROM (SELECT count(*) AS n FROM ride_group GROUP BY group_id)")
def cluster_counts(spark, d):
    n = fx.ride_group(spark, d).groupBy("group_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("shared"), F.sum("n").alias("users"))


@query("SELECT round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng FROM ends")
def map_center(spark, d):
    from wayfold.operators.network import ends

    return ends(fx.ride_request(spark, d)).agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lng"), 9).alias("lng"))


G_SQL = fx.SQL + """, grp AS (SELECT group_id, list(user_id ORDER BY user_id) AS users, count(*) AS size, min(stored_at) AS created_at, avg(origin_lat) AS olat, avg(origin_lng) AS olng, avg(destination_lat) AS dlat, avg(destination_lng) AS dlng,
 CASE count(*) WHEN 3 THEN 'complete' WHEN 2 THEN 'forming' ELSE 'expired' END AS status FROM ride_group GROUP BY group_id)
"""


def groups(spark, d):
    return st.groups(fx.ride_group(spark, d))


def joined(c):
    return F.array_join(c.cast("array<string>"), ",")


@query(G_SQL + "SELECT group_id, array_to_string(users, ',') AS users, size, status, created_at FROM grp")
def all_groups(spark, d):
    return groups(spark, d).select("group_id", joined(F.col("users")).alias("users"), "size", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(G_SQL + "SELECT group_id, status FROM grp")
def group_status(spark, d):
    return groups(spark, d).select("group_id", "status")


@query(G_SQL + "SELECT group_id, (row_number() OVER (ORDER BY group_id) - 1) % 4 AS colour FROM grp")
def group_color(spark, d):
    """Colours go round by a group's position among all."""
    g = st.numbered(groups(spark, d).select("group_id"), "group_id")
    return g.select("group_id", ((F.col("position") - 1) % 4).alias("colour"))


@query(G_SQL + "SELECT user_id, group_id, array_to_string([x FOR x IN users IF x <> user_id], ',') AS companions FROM (SELECT *, unnest(users) AS user_id FROM grp)")
def companions(spark, d):
    return st.notifications(groups(spark, d)).select("user_id", "group_id", "companions")


@query(G_SQL + "SELECT user_id, group_id, array_to_string([x FOR x IN users IF x <> user_id], ',') AS companions, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, round(olat, 6) AS meet_lat, round(olng, 6) AS meet_lng FROM (SELECT *, unnest(users) AS user_id FROM grp WHERE size > 1)")
def group_notifications(spark, d):
    return st.notifications(groups(spark, d).where("size > 1"))


@query(G_SQL + "SELECT group_id, round(olat, 9) AS origin_lat, round(olng, 9) AS origin_lng, round(dlat, 9) AS destination_lat, round(dlng, 9) AS destination_lng FROM grp")
def centroid_meeting_points(spark, d):
    return groups(spark, d).select("group_id", *(R(f"{e}_{c}", 9) for e in ("origin", "destination") for c in ("lat", "lng")))


@query(G_SQL + "SELECT user_id, group_id FROM (SELECT group_id, unnest(users) AS user_id FROM grp)")
def user_to_group(spark, d):
    return groups(spark, d).select(F.explode("users").alias("user_id"), "group_id")


@query(G_SQL + "SELECT r.user_id, coalesce(g.group_id::VARCHAR, 'none') AS group_id, coalesce(p.status, 'none') AS status FROM ride_request r LEFT JOIN ride_group g USING (user_id) LEFT JOIN grp p ON p.group_id = g.group_id")
def user_group_lookup(spark, d):
    g = groups(spark, d).select("group_id", "status", F.explode("users").alias("user_id"))
    return fx.ride_request(spark, d).select("user_id").join(g, "user_id", "left").select("user_id", F.coalesce(F.col("group_id").cast("string"), F.lit("none")).alias("group_id"), F.coalesce("status", F.lit("none")).alias("status"))


@query(G_SQL + "SELECT (SELECT count(*) FROM grp) AS groups, (SELECT count(*) FROM grp WHERE size = 3) AS complete, (SELECT count(*) FROM ride_request) AS users, (SELECT count(*) FROM ride_group) AS users_in_groups")
def service_status(spark, d):
    g = groups(spark, d).agg(F.count("*").alias("groups"), F.count_if(F.col("size") == 3).alias("complete"), F.sum("size").alias("users_in_groups"))
    return g.crossJoin(fx.ride_request(spark, d).agg(F.count("*").alias("users"))).select("groups", "complete", "users", "users_in_groups")


@query("SELECT user_id, origin_lat, origin_lng, destination_lat, destination_lng, stored_at, 1 AS passengers FROM ride_request")
def scan_locations(spark, d):
    return fx.ride_request(spark, d).select("user_id", "origin_lat", "origin_lng", "destination_lat", "destination_lng", F.col("stored_at").cast("timestamp_ntz").alias("stored_at"), F.lit(1).alias("passengers"))


@query("SELECT user_id, status FROM ride_request")
def all_users(spark, d):
    return fx.ride_request(spark, d).select("user_id", "status")


@query("SELECT user_id, min(source) AS source FROM (SELECT user_id, 'a' AS source FROM ride_request WHERE user_id % 2 = 0 UNION ALL SELECT user_id, 'b' FROM ride_request WHERE user_id % 3 = 0) GROUP BY user_id")
def ingest_union(spark, d):
    """All sources in the order of registration; a user's first row stays."""
    r = fx.ride_request(spark, d)
    both = r.where("user_id % 2 = 0").select("user_id", F.lit("a").alias("source")).unionByName(r.where("user_id % 3 = 0").select("user_id", F.lit("b").alias("source")))
    return both.groupBy("user_id").agg(F.min("source").alias("source"))


@query("SELECT user_id, stored_at, row_number() OVER (ORDER BY stored_at DESC, user_id) AS position FROM ride_request")
def locations_by_recency(spark, d):
    r = fx.ride_request(spark, d).select("user_id", F.col("stored_at").cast("timestamp_ntz").alias("stored_at"))
    return st.numbered(r, F.desc("stored_at"), F.col("user_id"))


@query("SELECT user_id, row_number() OVER (ORDER BY stored_at, user_id) AS arrival FROM ride_request WHERE user_id % 7 = 0")
def pending_users(spark, d):
    """Requests that are in no group yet, in the order of arrival."""
    r = fx.ride_request(spark, d).join(fx.ride_group(spark, d).select("user_id"), "user_id", "left_anti").where("status = 'pending'")
    return st.numbered(r.select("user_id", "stored_at"), "stored_at", "user_id", name="arrival").drop("stored_at")


@query("SELECT nation, count(*) AS pending FROM ride_request WHERE user_id % 7 = 0 GROUP BY nation HAVING count(*) >= 3")
def pending_gate(spark, d):
    return fx.ride_request(spark, d).where("user_id % 7 = 0").groupBy("nation").agg(F.count("*").alias("pending")).where("pending >= 3")


@query("SELECT user_id, strftime(stored_at, '%Y-%m-%dT%H:%M:%S') AS stored_at, count(*) OVER () AS total FROM ride_request WHERE user_id > 1")
def random_locations(spark, d):
    r = fx.ride_request(spark, d).where("user_id > 1").select("user_id", F.date_format("stored_at", "yyyy-MM-dd'T'HH:mm:ss").alias("stored_at"))
    return r.crossJoin(F.broadcast(r.agg(F.count("*").alias("total"))))


@query(f"SELECT user_id, round({KM.format(x=ANGLE.format(a='origin', b='destination'))}, 6) AS km FROM ride_request")
def haversine_km(spark, d):
    return fx.ride_request(spark, d).select("user_id", F.round(geo.haversine_km(*(F.col(c) for c in ("origin_lat", "origin_lng", "destination_lat", "destination_lng"))), 6).alias("km"))


@query("SELECT user_id, round(x, 6) AS dist, floor(x * 3 + 0.5)::BIGINT AS minutes, round(x * 1.5 + 3, 2) AS price FROM (SELECT user_id, sqrt((destination_lat - origin_lat) ** 2 + (destination_lng - origin_lng) ** 2) * 100 AS x FROM ride_request)")
def trip_estimate(spark, d):
    dist, minutes, price = geo.planar_trip(*(F.col(c) for c in ("origin_lat", "origin_lng", "destination_lat", "destination_lng")))
    return fx.ride_request(spark, d).select("user_id", F.round(dist, 6).alias("dist"), minutes.alias("minutes"), F.round(price, 2).alias("price"))


@query("""SELECT user_id, round(degrees(t), 9) AS lat, round(((degrees(lo + atan2(sin(b) * sin(d) * cos(la), cos(d) - sin(la) * sin(t))) + 180) % 360 + 360) % 360 - 180, 9) AS lng FROM (SELECT *, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(b)) AS t FROM (
 SELECT user_id, radians(origin_lat) AS la, radians(origin_lng) AS lo, 500::DOUBLE * sqrt((user_id * 37 % 101) / 101::DOUBLE) / 6371000::DOUBLE AS d, (user_id * 53 % 103) / 103::DOUBLE * 2::DOUBLE * pi() AS b FROM ride_request))""")
def random_point_in_circle(spark, d):
    """Points within 500 m of the origin, from numbers given by the id."""
    k = F.col("user_id")
    lat, lng = geo.point_in_circle(F.col("origin_lat"), F.col("origin_lng"), F.lit(500.0), (k * 37 % 101) / F.lit(101.0), (k * 53 % 103) / F.lit(103.0))
    return fx.ride_request(spark, d).select("user_id", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


@query("SELECT r.user_id, coalesce(nullif(p.city, ''), nullif(p.town, ''), nullif(p.village, '')) AS city, p.county, p.state FROM ride_request r LEFT JOIN place p USING (nation)")
def reverse_geocode(spark, d):
    p = fx.place(spark, d).select("nation", F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("city", "town", "village"))).alias("city"), "county", "state")
    return fx.ride_request(spark, d).select("user_id", "nation").join(F.broadcast(p), "nation", "left").drop("nation")


@query("""SELECT nation, CASE WHEN trim(split_part(a, ',', 1)) = '' THEN 'Unknown location' ELSE split_part(a, ',', 1) END AS name, CASE WHEN len(string_split(a, ',')) < 2 THEN 'No address available' ELSE trim(array_to_string(string_split(a, ',')[2:3], ',')) END AS address
 FROM (SELECT nation, CASE WHEN nation % 6 = 0 THEN city ELSE city || ', ' || village || ', ' || county || ', ' || coalesce(state, '') END AS a FROM place)""")
def parse_location_name(spark, d):
    whole = F.concat_ws(", ", "city", "village", "county", F.coalesce("state", F.lit("")))
    p = fx.place(spark, d).select("nation", F.split(F.when(F.col("nation") % 6 == 0, F.col("city")).otherwise(whole), ",").alias("a"))
    name = F.when(F.trim(F.col("a")[0]) == "", "Unknown location").otherwise(F.col("a")[0])
    return p.select("nation", name.alias("name"), F.when(F.size("a") < 2, "No address available").otherwise(F.trim(F.array_join(F.slice("a", 2, 2), ","))).alias("address"))


@query("SELECT user_id, round(origin_lat, 6) AS a, round(origin_lng, 6) AS b, round(destination_lat, 6) AS c, round(destination_lng, 6) AS d FROM ride_request")
def od_json_roundtrip(spark, d):
    """Written as JSON arrays of four numbers and read again."""
    r = fx.ride_request(spark, d).select("user_id", F.to_json(F.array("origin_lat", "origin_lng", "destination_lat", "destination_lng")).alias("j"))
    back = r.select("user_id", F.from_json("j", "array<double>").alias("x"))
    return back.select("user_id", *(F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate("abcd")))


@query("SELECT user_id, count(*) AS points, round(min(lat), 9) AS min_lat, round(max(lng), 9) AS max_lng FROM route_point GROUP BY user_id")
def route_lookup(spark, d):
    r = fx.ride_request(spark, d).select("user_id").join(fx.route(spark, d), "user_id")
    return r.select("user_id", F.size("pts").cast("long").alias("points"), F.round(F.array_min(F.transform("pts", lambda p: p.lat)), 9).alias("min_lat"), F.round(F.array_max(F.transform("pts", lambda p: p.lng)), 9).alias("max_lng"))


_P = lambda a, b: KM.format(x=f"sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lng - {a}.lng) / 2) ** 2")


@query(f"""SELECT a, b, round(avg(CASE WHEN d <= 0.5 THEN 1 ELSE 0 END), 6) AS overlap, avg(CASE WHEN d <= 0.5 THEN 1 ELSE 0 END) >= 0.8 AS overlaps FROM (
 SELECT a, b, s.i, min({_P('s', 'l')}) AS d FROM (SELECT a.user_id AS a, a.user_id + 1 AS b, CASE WHEN a.user_id % 7 <= (a.user_id + 1) % 7 THEN a.user_id ELSE a.user_id + 1 END AS short FROM ride_request a JOIN ride_request b ON b.user_id = a.user_id + 1) p
 JOIN route_point s ON s.user_id = p.short JOIN route_point l ON l.user_id = p.a + p.b - p.short GROUP BY a, b, s.i) GROUP BY a, b""")
def route_overlap(spark, d):
    """Routes of riders with successive ids, close at half a kilometre."""
    r = fx.ride_request(spark, d).select(F.col("user_id").alias("a"))
    pairs = r.join(r.select((F.col("a") - 1).alias("a")), "a").select("a", (F.col("a") + 1).alias("b"))
    return ic.overlap(pairs, fx.route(spark, d), close_km=0.5).select("a", "b", R("overlap"), "overlaps")


@query(f"""SELECT a.user_id AS a, b.user_id AS b, abs(epoch(a.stored_at) - epoch(b.stored_at)) / 60 AS minutes_apart, round({KM.format(x="sin(radians(b.destination_lat - a.destination_lat) / 2) ** 2 + cos(radians(a.destination_lat)) * cos(radians(b.destination_lat)) * sin(radians(b.destination_lng - a.destination_lng) / 2) ** 2")}, 6) AS dest_km
 FROM ride_intercity a JOIN ride_intercity b ON a.user_id < b.user_id AND a.origin_city IS NOT DISTINCT FROM b.origin_city AND abs(epoch(a.stored_at) - epoch(b.stored_at)) <= 1800 WHERE a.passengers + b.passengers <= 3""")
def intercity_pairs(spark, d):
    """All fixtures lie within 30 km, so near destinations decide; route_overlap checks the other way."""
    return ic.matching_pairs(fx.ride_intercity(spark, d), fx.route(spark, d)).select("a", "b", "minutes_apart", R("dest_km"))


@query("SELECT coalesce(origin_city, 'null') AS city, count(*) AS users, sum(passengers)::BIGINT AS passengers FROM ride_intercity WHERE user_id % 13 <> 0 GROUP BY ALL")
def intercity_users(spark, d):
    """Users by city after those divisible by thirteen were removed."""
    return fx.ride_intercity(spark, d).where("user_id % 13 <> 0").groupBy(F.coalesce("origin_city", F.lit("null")).alias("city")).agg(F.count("*").alias("users"), F.sum("passengers").alias("passengers"))


@query("SELECT user_id, arg_min(seq, seq) AS seq, arg_min(lat, seq) AS lat, arg_min(lng, seq) AS lng FROM location_event WHERE op = 'add' GROUP BY user_id")
def first_write_wins(spark, d):
    return st.first_writes(fx.location_event(spark, d))


@query("SELECT user_id, seq, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM location_event) WHERE r = 1 AND op <> 'remove'")
def last_write_wins(spark, d):
    return st.last_writes(fx.location_event(spark, d))


@query("SELECT user_id, max(ts) AS ts FROM location_event WHERE op <> 'remove' GROUP BY user_id")
def location_latest(spark, d):
    return fx.location_event(spark, d).where("op <> 'remove'").groupBy("user_id").agg(F.max("ts").alias("ts"))


@query("SELECT key, seq, value FROM (SELECT user_id % 40 AS key, seq, op, user_id AS value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY seq DESC) AS r FROM location_event) WHERE r = 1 AND op <> 'remove'")
def api_state_fold(spark, d):
    return st.api_state(fx.location_event(spark, d).select((F.col("user_id") % 40).alias("key"), "seq", "op", F.col("user_id").alias("value")))


@query("SELECT seq, op, user_id, row_number() OVER (ORDER BY seq DESC) AS position FROM location_event ORDER BY seq DESC LIMIT 10")
def last_10_events(spark, d):
    from pyspark.sql import Window

    top = fx.location_event(spark, d).orderBy(F.desc("seq")).limit(10)
    return top.select("seq", "op", "user_id", F.row_number().over(Window.orderBy(F.desc("seq"))).cast("long").alias("position"))


@query("SELECT o_custkey AS user_id, o_orderkey AS ride_id, o_orderdate AS time, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders")
def user_rides_desc(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("time"), "ride_id")
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("ride_id"), F.col("o_orderdate").alias("time"))
    return o.withColumn("position", F.row_number().over(order).cast("long"))


@query("SELECT user_id, 'only_users' AS side FROM ride_request WHERE user_id NOT IN (SELECT user_id FROM ride_group) UNION ALL SELECT user_id, 'only_groups' FROM ride_group WHERE user_id NOT IN (SELECT user_id FROM ride_request WHERE user_id % 5 <> 0)")
def id_diff(spark, d):
    """Ids that are only among requests, and ids that are only in groups once requests divisible by five are gone."""
    u, g = fx.ride_request(spark, d).select("user_id"), fx.ride_group(spark, d).select("user_id")
    return u.join(g, "user_id", "left_anti").withColumn("side", F.lit("only_users")).unionByName(g.join(u.where("user_id % 5 <> 0"), "user_id", "left_anti").withColumn("side", F.lit("only_groups")))
