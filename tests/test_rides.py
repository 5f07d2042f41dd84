"""Ride operators against DuckDB, plain models and invariants."""

import datetime
import heapq
import random

import duckdb
import pandas as pd
import numpy as np
import pytest

import __spark_entry__ as entry
from wayfold.functions import geo
from wayfold.operators import bucketing, clusters, commit, cosine, farfield, intercity, network, storage
from wayfold.plans import folds, registry
from wayfold.plans import network as plans
from wayfold.sources import fixtures as fx
from wayfold.sources import registry as sources
from wayfold.streaming import grouping

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["snap_nearest_node", "snap_nearest_edge", "knn_spatial", "network_knn", "walking_distance", "mpb_pair_score", "lsh_top2", "mips_pairs", "intercity_pairs", "route_overlap", "cluster_evaluation", "group_color", "api_state_fold", "parse_location_name", "random_point_in_circle", "id_diff"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in want.columns) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert registry.ORACLE_SQL.keys() <= registry.QUERIES.keys()
    assert entry.queries().keys() >= registry.QUERIES.keys()


def graph(seed=0, n=40, m=110):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), float(rng.randint(50, 400))) for _ in range(m)]


def dijkstra(edges, s, cutoff):
    best, queue = {s: 0.0}, [(0.0, s)]
    while queue:
        d, u = heapq.heappop(queue)
        for a, b, w in edges:
            if a == u and d + w <= cutoff and d + w < best.get(b, 1e18):
                best[b] = d + w
                heapq.heappush(queue, (d + w, b))
    return best


def test_shortest_paths_both_ways(spark, monkeypatch):
    edges = graph()
    e, s = spark.createDataFrame(edges, "u long, v long, length double"), spark.createDataFrame([(k,) for k in range(0, 40, 5)], "src long")
    want = {(k, v): d for k in range(0, 40, 5) for v, d in dijkstra(edges, k, 700).items()}
    assert {(r.src, r.node): r.dist for r in network.shortest(s, e, 700).collect()} == want
    monkeypatch.setattr(network, "MOST_EDGES", 0)
    assert {(r.src, r.node): r.dist for r in network.shortest(s, e, 700).collect()} == want
    near = network.shortest(s, e, 700, 3).groupBy("src").count().collect()
    assert all(r["count"] <= 3 for r in near)


def test_graph_is_flat_where_it_is_sent(spark):
    """No object an edge, in the driver or in what is sent; ids need not be small, and a source without edges finds itself."""
    edges = [(10**12 + u, 10**12 + v, w) for u, v, w in graph()]
    e = spark.createDataFrame(edges, "u long, v long, length double")
    sent = network.sent_graph(e).value
    assert all(isinstance(x, np.ndarray) for x in sent.__getstate__())
    assert sum(x.nbytes for x in sent.__getstate__()) <= 12 * len(edges) + 16 * len(sent.nodes) + 8
    s = spark.createDataFrame([(10**12,), (10**12 + 7,), (3,)], "src long")
    want = {(k, v): d for k in (10**12, 10**12 + 7) for v, d in dijkstra(edges, k, 700).items()} | {(3, 3): 0.0}
    assert {(r.src, r.node): r.dist for r in network.shortest(s, e, 700).collect()} == want
    pairs = spark.createDataFrame([(3, 3), (10**12, 10**12), (3, 10**12), (10**12, 3)], "src long, node long")
    assert {tuple(r) for r in network.paths_between(pairs, e).collect()} == {(3, 3, 0.0), (10**12, 10**12, 0.0)}
    with pytest.raises(ValueError):
        network.shortest(s, e.union(e.limit(1).selectExpr("u", "v", "-1.0D AS length")), 700)


def trips(spark, seed=6, n=24):
    """Nodes on a line, streets both ways but for a part that none leads to, and trips between places at the nodes."""
    rng = random.Random(seed)
    nodes = [(k, 35.9 + k * 0.01, 50.7) for k in range(20)]
    edges = [e for k in range(17) for e in ((k, k + 1, 1200.0 + k), (k + 1, k, 1200.0 + k))] + [(18, 19, 1.0), (19, 18, 1.0)]
    place = lambda k: (nodes[k][1] + rng.choice([0, 3e-4]), nodes[k][2])
    rows = [(u, *place(rng.randrange(20)), *place(rng.randrange(20))) for u in range(n)] + [(n, *nodes[0][1:], *nodes[17][1:]), (n + 1, *nodes[0][1:], *nodes[19][1:]), (n + 2, *nodes[4][1:], *nodes[4][1:])]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return nodes, edges, rows, made(nodes, "node_id long, lat double, lng double"), made(edges, "u long, v long, length double"), made(rows, "user_id long, origin_lat double, origin_lng double, destination_lat double, destination_lng double")


def great_circle(a, b):
    import math

    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(x))


def walk(nodes, edges, a, b):
    if abs(a[0] - b[0]) < 1e-6 and abs(a[1] - b[1]) < 1e-6:
        return 0.0
    s, t = (min(nodes, key=lambda n: great_circle(p, n[1:]))[0] for p in (a, b))
    return dijkstra(edges, s, 1e17).get(t, great_circle(a, b)) if s != t else great_circle(a, b)


def test_walking_has_no_cutoff(spark, monkeypatch):
    nodes, edges, rows, n, e, r = trips(spark)
    want = {u: walk(nodes, edges, (a, b), (c, d)) for u, a, b, c, d in rows}
    assert max(want.values()) > 20_000
    for most in (network.MOST_EDGES, 0):
        monkeypatch.setattr(network, "MOST_EDGES", most)
        assert {x.user_id: x.dist_m for x in network.walking_distances(r, n, e).collect()} == pytest.approx(want)


def test_silhouettes_by_blocks(spark, monkeypatch):
    """Against plain loops, with blocks smaller than clusters, equal places, a cluster of one and a side with one cluster."""
    monkeypatch.setattr(clusters, "BLOCK", 5)
    rng = random.Random(4)
    rows = [(u, u % 3 if u else 9, "orig", 35.9 + rng.random() / 10, 50.7 + rng.random() / 10) for u in range(30)]
    rows += [(u, 1, "dest", 35.9, 50.7 + u / 100) for u in range(7)] + [(40, 1, "orig", *rows[4][3:]), (41, 2, "orig", -35.0, -129.0)]
    m = spark.createDataFrame(rows, "user_id long, label int, side string, lat double, lng double")
    orig = [r for r in rows if r[2] == "orig"]
    want = {(u, t): [great_circle((la, ln), x[3:]) for x in orig if x[1] == t and x[0] != u] for u, _, _, la, ln in orig for t in (0, 1, 2, 9)}
    sums = clusters.far_sums(m).where("side = 'orig'").collect()
    assert {(r.user_id, r.to): r.n for r in sums} == {k: len(v) for k, v in want.items() if v}
    assert {(r.user_id, r.to): r.s for r in sums} == pytest.approx({k: sum(v) for k, v in want.items() if v}, rel=1e-9)
    each = []
    for u, label, *_ in orig:
        b = min(sum(v) / len(v) for (x, t), v in want.items() if x == u and t != label and v)
        own = want[u, label]
        each.append((b - sum(own) / len(own)) / max(b, sum(own) / len(own)) if own else 0.0)
    got = {r.side: r.silhouette for r in clusters.silhouettes(m).collect()}
    assert got == pytest.approx({"orig": sum(each) / len(each), "dest": -1.0})


def test_far_places_add_up_as_pair_by_pair():
    """A town, a long strip, the whole globe (poles, date line, antipodes) and equal places; along a strip the work is less than all pairs."""
    rng = np.random.default_rng(3)
    n = 6000
    globe = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    for lat, lng, most in ((35 + rng.random(n) / 5, 50 + rng.random(n) / 5, 9.0), (35 + 24 * rng.random(n), 50 + rng.random(n) / 20, 0.5), (*globe, 9.0), (np.full(n, 35.0), 50.0 + (np.arange(n) % 2), 9.0)):
        lat, lng, group = np.radians(lat), np.radians(lng), rng.integers(0, 5, n)
        seen, plain = 0, farfield.half_angles

        def counted(a, b):
            nonlocal seen
            seen += a.shape[1] * b.shape[1]
            return plain(a, b)

        farfield.half_angles = counted
        try:
            got = farfield.sums(lat, lng, farfield.Tree(lat, lng, group, 5))
        finally:
            farfield.half_angles = plain
        assert seen < most * n * n
        for k in range(0, n, 97):
            q = np.sin((lat - lat[k]) / 2) ** 2 + np.cos(lat) * np.cos(lat[k]) * np.sin((lng - lng[k]) / 2) ** 2
            want = np.bincount(group, 2 * 6371000 * np.arcsin(np.sqrt(np.minimum(q, 1))), 5)
            assert got[k] == pytest.approx(want, rel=1e-11, abs=1e-6)


def test_silhouettes_make_no_row_for_a_member_and_a_cluster(spark, monkeypatch):
    """Slices and boxes smaller than clusters, a rider in two clusters and one without a place."""
    monkeypatch.setattr(clusters, "SLICE", 7)
    rng = random.Random(14)
    rows = [(u, u % 4, "orig", 35.9 + rng.random() / 10, 50.7 + rng.random() / 10) for u in range(40)] + [(5, 3, "orig", 35.91, 50.72), (50, 0, "orig", None, 50.7)]
    m = spark.createDataFrame(rows, "user_id long, label int, side string, lat double, lng double")
    far = {}
    for r in clusters.far_sums(m.where("lat IS NOT NULL")).collect():
        far.setdefault((r.user_id, r.label), {})[r.to] = r.s, r.n
    monkeypatch.setattr(clusters, "far_sums", None)
    got = {(r.user_id, r.label): r for r in clusters.member_sums(m).collect()}
    assert got.keys() == far.keys() | {(50, 0)}
    for (u, label), to in far.items():
        r, (s, n) = got[u, label], to[label]
        assert (r.s, r.n, r.b) == pytest.approx((s, n, min(x / k for t, (x, k) in to.items() if t != label)))
    assert (got[50, 0].n, got[50, 0].b) == (0, None)


def test_evaluation_makes_no_pairs(spark, monkeypatch):
    """Medoids, mean distances and silhouettes come from one comparison by blocks, with equal places and a cluster of one."""
    monkeypatch.setattr(clusters, "BLOCK", 6)
    rng = random.Random(9)
    rows = [(u, u % 3 if u else 9, side, 35.9 + rng.random() / k, 50.7 + rng.random() / k) for k, side in ((10, "orig"), (0.05, "dest")) for u in range(25)]
    rows += [(30, 1, side, *next(r for r in rows if r[0] == 4 and r[2] == side)[3:]) for side in ("orig", "dest")]
    m = spark.createDataFrame(rows, "user_id long, label int, side string, lat double, lng double")
    sse, intra, wide, least = 0.0, 0.0, 0.0, 0.0
    for side in ("orig", "dest"):
        of = {t: [r for r in rows if r[1:3] == (t, side)] for t in (0, 1, 2, 9)}
        d = {(a[0], b[0]): great_circle(a[3:], b[3:]) for x in of.values() for a in x for b in x if a[0] != b[0]}
        centre = {t: min(x, key=lambda a: (round(sum(d.get((a[0], b[0]), 0.0) for b in x), 6), a[0])) for t, x in of.items()}
        sse += sum(great_circle(a[3:], centre[t][3:]) ** 2 for t, x in of.items() for a in x)
        means = [sum(d[a[0], b[0]] for a in x for b in x if a is not b) / max(1, len(x) * (len(x) - 1)) for x in of.values()]
        intra += sum(means) / 4
        if side == "orig":
            wide, least = max(means), min(great_circle(centre[i][3:], centre[j][3:]) for i in of for j in of if i < j)
    want = sum(r.silhouette for r in clusters.silhouettes(m).collect()) / 2

    def pairs(*_):
        raise AssertionError("pairs of members are listed")

    monkeypatch.setattr(clusters, "within", pairs)
    got = clusters.evaluation(m).first()
    assert (got.sse, got.intra, got.dunn, got.silhouette, got.n_clusters) == pytest.approx((sse, intra, least / wide, want, 4))


def test_clusters_over_walking_distances(spark):
    """Sums, medoids and silhouettes against plain loops over walking distances."""
    nodes, edges, rows, n, e, r = trips(spark, 8, 12)
    m = clusters.members(r, spark.createDataFrame([(x[0], x[0] % 3) for x in rows], "user_id long, label int"), n)
    at = {u: (a, b) for u, a, b, _, _ in rows}
    far = {(i, j): walk(nodes, edges, at[i], at[j]) for i in at for j in at}
    of = {k: [u for u in at if u % 3 == k] for k in range(3)}
    medoid = {k: min(us, key=lambda u: (round(sum(far[u, v] for v in us), 6), u)) for k, us in of.items()}
    orig = lambda df: df.where("side = 'orig'").collect()
    got = clusters.medoids(m, e)
    assert {x.label: x.user_id for x in orig(got)} == medoid
    assert {x.user_id: x.d for x in orig(clusters.to_centre(m, got, e))} == pytest.approx({u: far[u, medoid[u % 3]] for u in at})
    assert {(x.user_id, x.other): x.d for x in orig(clusters.within(m, e))} == pytest.approx({(u, v): far[u, v] for us in of.values() for u in us for v in us if u != v})
    assert {(x.i, x.j): x.d for x in clusters.between(got, edges=e).collect()} == pytest.approx({(i, j): far[medoid[i], medoid[j]] for i in of for j in of if i < j})
    mean = lambda u, us: sum(far[u, v] for v in us if v != u) / len([v for v in us if v != u])
    both = [(mean(u, of[u % 3]), min(mean(u, of[k]) for k in of if k != u % 3)) for u in at]
    assert orig(clusters.silhouettes(m, e))[0].silhouette == pytest.approx(sum((b - a) / max(a, b) for a, b in both) / len(both))
    sse = {x.side: x.sse for x in clusters.squared_error(clusters.to_centre(m, got, e)).collect()}
    assert clusters.evaluation(m, edges=e).first().sse == pytest.approx(sum(sse.values()))


def test_snap_widens_its_search(spark):
    rng = random.Random(1)
    nodes = [(k, rng.uniform(35, 36), rng.uniform(50, 51)) for k in range(30)]
    points = [(k, rng.uniform(34, 37), rng.uniform(49, 52)) for k in range(40)] + [(99, None, 50.0)]
    got = {r.point_id: r.node for r in network.snap(spark.createDataFrame(points, "point_id long, lat double, lng double"), spark.createDataFrame(nodes, "node_id long, lat double, lng double"), cell=0.01).collect()}
    import math

    def hav(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return math.asin(math.sqrt(x))

    assert got == {p[0]: min(nodes, key=lambda n: (hav(p, n), n[0]))[0] for p in points if p[1]}


def test_nearest_on_edges_whichever_way_and_length(spark):
    """One-way streets stored as u > v, long streets that pass a point far from their ends, points far from all."""
    rng = random.Random(3)
    nodes = [(k, rng.uniform(35.8, 36.0), rng.uniform(50.7, 50.9)) for k in range(24)] + [(50, 36.2, 50.7), (51, 36.2, 50.9)]
    edges = [(rng.randrange(24), rng.randrange(24), 1.0) for _ in range(14)] + [(9, 2, 1.0), (51, 50, 1.0)]
    points = [(k, rng.uniform(35.7, 36.1), rng.uniform(50.6, 51.0)) for k in range(40)] + [(90, 36.2001, 50.8), (91, 37.5, 50.0), (92, None, 50.0)]
    where = {k: (a, b) for k, a, b in nodes}
    import math

    def off(p, u, v):
        kx, ky = math.cos(math.radians(p[1])) * network.METRES_A_DEGREE, network.METRES_A_DEGREE
        (ax, ay), (bx, by) = (((where[n][1] - p[2]) * kx, (where[n][0] - p[1]) * ky) for n in (u, v))
        t = max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(ax + (bx - ax) * t, ay + (by - ay) * t)

    want = {p[0]: min((round(off(p, u, v), 6), u, v) for u, v in {(min(e[:2]), max(e[:2])) for e in edges if e[0] != e[1]}) for p in points if p[1]}
    got = network.nearest_on_edges(spark.createDataFrame(points, "point_id long, lat double, lng double"), spark.createDataFrame(nodes, "node_id long, lat double, lng double"), spark.createDataFrame(edges, "u long, v long, length double")).collect()
    assert {r.point_id: (r.u, r.v) for r in got} == {k: w[1:] for k, w in want.items()}
    assert all(abs(r.dist_m - want[r.point_id][0]) < 1e-4 for r in got)


def riders(seed=0, n=40, nodes=60, k=12):
    rng = random.Random(seed)
    return {u: {s: {v: float(rng.randint(0, 900)) for v in rng.sample(range(nodes), k)} for s in ("orig", "dest")} for u in range(n)}


def global_fold(near, removed=()):
    m = commit.MeetingPoints()
    for u in sorted(near):
        m.add(u, near[u])
    for u in removed:
        m.remove(u)
    return sorted((a, tuple(u), o, d) for a, u, o, d in m.rows())


@pytest.mark.parametrize("removed", [(), (3, 8, 13, 21)])
def test_parts_fold_as_the_whole(spark, removed):
    near = riders(4, n=60, nodes=160, k=8)
    df = spark.createDataFrame([(u, s, v, d) for u, sides in near.items() for s, nodes in sides.items() for v, d in nodes.items()], "user_id long, side string, node long, dist double")
    got = commit.meeting_groups(df, bucketing.pairs(df), removed).collect()
    assert sorted((r.first_user, tuple(r.users), r.orig_node, r.dest_node) for r in got) == global_fold(near, removed)


@pytest.mark.parametrize("name", ["mpb_groups", "mpb_remove"])
def test_groups_read_near_nodes_of_linked_riders_only(spark, monkeypatch, name):
    """As from the near nodes of all riders, which are not made."""
    near = network.checkpointed(plans.near(spark, SF))
    rows = lambda df: sorted((r.first_user, tuple(r.users), r.orig_node, r.dest_node) for r in df.collect())
    want = rows(commit.meeting_groups(near, network.checkpointed(bucketing.pairs(near)), folds.REMOVED if name == "mpb_remove" else ()))

    def refuse(*_):
        raise AssertionError("near nodes of all riders are made")

    monkeypatch.setattr(plans, "near", refuse)
    assert want and rows(registry.QUERIES[name](spark, SF)) == want


def test_group_invariants():
    for seed in range(10):
        near = riders(seed)
        m = commit.MeetingPoints()
        for u in near:
            m.add(u, near[u])
        seen = [u for g in m.groups.values() for u in g["users"]]
        assert len(seen) == len(set(seen))
        for g in m.groups.values():
            assert len(g["users"]) in (2, 3)
            for u in g["users"]:
                assert g["meet"][0] in near[u]["orig"] and g["meet"][1] in near[u]["dest"]
        again = m.add(0, near[0])
        assert again == m.group_of.get(0)


def test_folds_by_hand():
    assert commit.minhash_fold([(2, 1, 0.9), (3, 2, 0.8), (3, 1, 0.7), (4, 3, 0.9)], [1, 2, 3, 4]) == [(1, 2, 3)]
    assert commit.minhash_fold([(3, 1, 0.9), (3, 2, 0.8)], [1, 2, 3], [1, 2]) == []
    assert commit.cosine_fold([(2, 1, 0.9), (3, 1, 0.95), (4, 1, 0.8), (5, 4, 0.9)], [1, 2, 3, 4, 5]) == [[1, 3, 2], [4, 5]]
    assert commit.intercity_fold([1, 2, 3, 4], {1: 1, 2: 2, 3: 1, 4: 1}, {(1, 2), (1, 3), (3, 4)}) == [[1, 2], [3, 4]]
    assert commit.intercity_fold([1], {1: 3}, set()) == [[1]]
    assert commit.storage_fold([(1, "add", 1), (2, "add", 2), (3, "add", 3), (4, "add", 1), (5, "remove", 2), (6, "remove", 3)]) == [(1, "pending")]


def test_intercity_pairs_by_blocks(spark, monkeypatch):
    """Against plain loops: destinations near and far, routes that overlap, one without a route, blocks smaller than slots."""
    rng = random.Random(3)
    people, ways = [], {}
    for u in range(60):
        lat, lng, hours = 35.0 + rng.random() * 2, 50.0 + rng.random() / 5, rng.choice([0, 10, 29, 30, 31, 59, 61, 90])
        people.append((u, rng.choice(["x", None]), datetime.datetime(2024, 1, 1, 9) + datetime.timedelta(minutes=hours), lat, lng, rng.choice([1, 2])))
        if u % 9:
            ways[u] = [(35.0 + (lat - 35.0) * k / 4, 50.0 + (lng - 50.0) * k / 4) for k in range(5 + u % 2)]
    r = spark.createDataFrame(people, "user_id long, origin_city string, stored_at timestamp, destination_lat double, destination_lng double, passengers int")
    routes = spark.createDataFrame([*ways.items()], "user_id long, pts array<struct<lat double, lng double>>")

    def overlap(a, b):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return sum(any(great_circle(p, q) <= 20_000 for q in long) for p in short) / len(short) >= 0.8

    want, by_route = set(), 0
    for a in people:
        for b in people:
            if a[0] < b[0] and a[1] == b[1] and abs((a[2] - b[2]).total_seconds()) <= 1800 and a[5] + b[5] <= 3:
                near = great_circle(a[3:5], b[3:5]) <= 30_000
                over = not near and a[0] in ways and b[0] in ways and overlap(ways[a[0]], ways[b[0]])
                by_route += over
                if near or over:
                    want.add((a[0], b[0]))
    assert by_route > 3
    for block in (2_000, 4):
        monkeypatch.setattr(intercity, "BLOCK", block)
        rows = intercity.matching_pairs(r, routes).collect()
        assert sorted((p.a, p.b) for p in rows) == sorted(want)
        assert all(abs(p.dest_km * 1000 - great_circle(people[p.a][3:5], people[p.b][3:5])) < 1e-3 for p in rows)


def test_intercity_routes_are_not_broadcast(spark):
    """However small Spark takes the routes for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        df = intercity.matching_pairs(fx.ride_intercity(spark, SF), fx.route(spark, SF))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "Join" in x and "LeftOuter" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_intercity_fold_reads_mates_only():
    class Riders(list):
        def __getitem__(self, k):
            raise AssertionError("later riders are gone through one by one")

    n = 20_000
    assert commit.intercity_fold(Riders(range(n)), dict.fromkeys(range(n), 1), {(u, u + 1) for u in range(0, n, 2)}) == [[u, u + 1] for u in range(0, n, 2)]


def test_bands_are_made_of_the_functions_they_read(spark):
    from wayfold.operators import lsh

    nodes = np.arange(50, 90)
    assert (lsh.banded_hashes(nodes) == lsh.hashes(nodes)[:, : lsh.BANDS]).all()
    o, d = ([lsh.hashes(x).min(0).tolist()] for x in (nodes[:20], nodes[15:]))
    rows = spark.createDataFrame([(*o, *d), (o[0][: lsh.BANDS], d[0][: lsh.BANDS])], "os array<long>, ds array<long>")
    whole, half = (r.b for r in rows.select(lsh.bands(lsh.merged(geo.F.col("os"), geo.F.col("ds"))).alias("b")).collect())
    assert whole == half and len(half) == lsh.BANDS and None not in half


def test_intercity_null_cities_are_one(spark):
    rows = [(1, None, "2024-01-01 00:29:00", 1), (2, None, "2024-01-01 00:31:00", 1), (3, "a", "2024-01-01 00:29:00", 1), (4, "a", "2024-01-01 01:29:00", 1), (5, None, "2024-01-01 00:30:00", 3)]
    r = spark.createDataFrame(rows, "user_id long, origin_city string, stored_at string, passengers int").selectExpr("*", "35.9D AS destination_lat", "50.7D AS destination_lng").withColumn("stored_at", geo.F.to_timestamp("stored_at"))
    routes = spark.createDataFrame([], "user_id long, pts array<struct<lat: double, lng: double>>")
    assert [(p.a, p.b) for p in intercity.matching_pairs(r, routes).collect()] == [(1, 2)]


def test_dense_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r.a, r.b) for r in cosine.dense_pairs(df).collect()] == [(1, 2)]


def test_first_and_last_writes(spark):
    e = spark.createDataFrame([(1, "add", 1, 0.0, 0.0), (2, "add", 1, 1.0, 1.0), (3, "remove", 2, 0.0, 0.0), (4, "add", 2, 5.0, 5.0), (5, "remove", 1, 0.0, 0.0)], "seq long, op string, user_id long, lat double, lng double")
    assert {r.user_id: r.lat for r in storage.first_writes(e).collect()} == {1: 0.0, 2: 5.0}
    assert {r.user_id: r.lat for r in storage.last_writes(e).collect()} == {2: 5.0}


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read(spark, "api")
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, None, "pending", 1)], sources.REQUEST)
    seen = []
    errors = sources.write(df, ["nothing", "callback", "json", "parquet"], path=str(tmp_path / "out"), callback=lambda d: seen.append(d.count()))
    assert seen == [1] and not errors
    bad = sources.write(df, ["callback", "json"], path=str(tmp_path / "two"), callback=lambda d: 1 / 0)
    assert [k for k, _ in bad] == ["callback"] and sources.read(spark, "json", path=str(tmp_path / "two")).count() == 1
    (tmp_path / "od.json").write_text("[[35.8, 50.7, 35.9, 50.8], [35.1, 50.2, 35.3, 50.4]]")
    assert [r.destination_lng for r in sources.read(spark, "od_json", path=str(tmp_path / "od.json")).orderBy("user_id").collect()] == [50.8, 50.4]
    assert sources.union_all([df, df.select("user_id")]).count() == 2


def test_sql_functions(spark):
    geo.register(spark)
    r = spark.sql("SELECT haversine_km(0D, 0D, 0D, 1D) AS km, exp_decay(1000D) AS e, gaussian_weight(0D) AS g").first()
    assert abs(r.km - 111.19) < 0.01 and abs(r.e - 0.3679) < 1e-3 and r.g == 1.0


def test_stream_of_arrivals(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    batches = [[(1, "add", 1), (2, "add", 2)], [(3, "add", 3), (4, "add", 4)], [(5, "remove", 1), (6, "remove", 2)]]
    for k, b in enumerate(batches):
        pd.DataFrame([(s, o, u, f"2024-01-01T00:00:0{k}") for s, o, u in b], columns=["seq", "op", "user_id", "ts"]).to_json(src / f"{k}.json", orient="records", lines=True)
    events = sources.read(spark, "stream", path=str(src), schema=sources.EVENT).withColumn("region", geo.F.lit("r"))
    q = grouping.states(events).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM states").collect():
        last[r.user_id] = r.state
    want = dict(commit.storage_fold([e for b in batches for e in b]))
    assert {u: s for u, s in last.items() if s != "removed"} == want


def test_batches_below_the_gate_wait(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, n in enumerate((2, 4)):
        pd.DataFrame([(k * 10 + i, "add", i, "2024-01-01T00:00:00") for i in range(n)], columns=["seq", "op", "user_id", "ts"]).to_json(src / f"{k}.json", orient="records", lines=True)
    seen = []
    grouping.run_batches(sources.read(spark, "stream", path=str(src), schema=sources.EVENT), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), None).awaitTermination(60)
    assert seen == [4]


def test_small_batches_add_up_to_the_gate(spark, tmp_path):
    """Two rows a batch: arrivals wait for the third user, removals are kept, users left pending count on, over a restart too."""
    src = tmp_path / "in"
    src.mkdir()
    batches = [[("add", 1), ("add", 2)], [("remove", 2), ("add", 3)], [("add", 4)], [("remove", 1), ("add", 5)], [("add", 6)], [("remove", 6)]]
    seen = []

    def handle(df, n):
        seen.append(sorted((r.seq, r.op, r.user_id) for r in df.collect()))
        return [4] if len(seen) == 1 else None

    def run(at):
        for k in at:
            pd.DataFrame([(k * 10 + i, op, u, "2024-01-01T00:00:00") for i, (op, u) in enumerate(batches[k])], columns=["seq", "op", "user_id", "ts"]).to_json(src / f"{k}.json", orient="records", lines=True)
        grouping.run_batches(sources.read(spark, "stream", path=str(src), schema=sources.EVENT), handle, str(tmp_path / "c"), None).awaitTermination(60)

    run([0])
    assert seen == []
    for k in (1, 2, 3):
        run([k])
    assert seen == [[(0, "add", 1), (1, "add", 2), (10, "remove", 2), (11, "add", 3), (20, "add", 4)]]
    run([4])
    assert seen[1:] == [[(20, "add", 4), (30, "remove", 1), (31, "add", 5), (40, "add", 6)]]
    run([5])
    assert len(seen) == 2


def test_fixtures_agree_on_edges(spark, con):
    assert fx.road_edge(spark, SF).count() == con.sql(fx.SQL + "SELECT count(*) FROM road_edge").fetchall()[0][0] == 692
