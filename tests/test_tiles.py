"""Searches by tiles of the network against plain searches and the operators on whole tables."""

import random

import pytest

from wayfold.operators import bucketing, cosine, lsh, network
from wayfold.operators.tiles import Network
from tests.test_rides import dijkstra


def town(seed=3, n=70):
    """Nodes over some 0.06 degrees, one-way edges between near ones, and a node without edges."""
    rng = random.Random(seed)
    nodes = [(i, 35.9 + rng.random() * 0.06, 50.7 + rng.random() * 0.02) for i in range(n)]
    far = lambda a, b: abs(a[1] - b[1]) + abs(a[2] - b[2])
    edges = [(a[0], b[0], round(far(a, b) * 111_194 * (0.8 + rng.random()), 3) + 1) for a in nodes[:-1] for b in sorted(nodes[:-1], key=lambda b, a=a: far(a, b))[1:4]]
    return nodes, edges


@pytest.fixture
def located(spark):
    nodes, edges = town()
    return spark.createDataFrame(nodes, "node_id long, lat double, lng double"), spark.createDataFrame(edges, "u long, v long, length double"), edges


def test_nearest_nodes_bring_no_graph_to_the_driver(spark, located, monkeypatch):
    n, e, edges = located

    def refuse(*_):
        raise AssertionError("the graph was sent or relaxed by joins")

    monkeypatch.setattr(network, "sent_graph", refuse)
    monkeypatch.setattr(network, "relaxed", refuse)
    got = {}
    for r in network.nearest_nodes(n, e, 6, 1500.0).collect():
        got.setdefault(r.src, []).append((r["rank"], r.node, round(r.dist, 6)))
    for s in range(70):
        want = sorted((round(d, 6), v) for v, d in dijkstra(edges, s, 1500.0).items())[:6]
        assert sorted(got[s]) == [(i + 1, v, d) for i, (d, v) in enumerate(want)]


def test_pairs_by_cells_are_those_of_whole_tables(spark, located):
    n, e, _ = located
    rng = random.Random(5)
    at = spark.createDataFrame([(u, s, rng.choice([69, rng.randrange(70), rng.randrange(12)])) for u in range(60) for s in ("orig", "dest")], "user_id long, side string, node long")
    net = Network(n, e, 8, 1500.0)
    assert net.fits
    near = network.checkpointed(net.nearest(at.withColumnRenamed("node", "src"), ranked=False).drop("src"))
    who = network.checkpointed(bucketing.riders(at, net))
    rows = lambda df, *c: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    cols = ("user_id", "cand_id", "n_orig", "n_dest", "orig_score", "dest_score", "orig_node", "dest_node", "total")
    assert rows(bucketing.network_pairs(bucketing.candidates(who), net), *cols) == rows(bucketing.pairs(near), *cols)
    for t in (0.7, 0.3):
        want = rows(cosine.sparse_pairs(cosine.features(near, 1000), t), "user_id", "cand_id", "cos")
        assert want and rows(cosine.network_pairs(who, net, t), "user_id", "cand_id", "cos") == want
    signed = {r.src: r.signature for r in net.least(n.selectExpr("node_id AS src"), lsh.hashes, "signature").collect()}
    assert signed == {r.src: r.signature for r in lsh.signatures(net.nearest(n.selectExpr("node_id AS src"))).collect()}


def test_sides_are_scored_in_the_tasks_of_tiles(spark, located):
    """As from the table of near nodes, with users of one node, one without edges, and pairs across tiles."""
    n, e, _ = located
    rng = random.Random(12)
    at = spark.createDataFrame([(u, s, rng.choice([69, rng.randrange(70), rng.randrange(12)])) for u in range(80) for s in ("orig", "dest")], "user_id long, side string, src long")
    rows = lambda df: sorted((r.user_id, r.cand_id, r.side, r.shared, round(r.score, 6), r.node) for r in df.collect())
    for k, cutoff in ((8, 1500.0), (5, 300.0)):
        net = Network(n, e, k, cutoff)
        near = network.checkpointed(net.nearest(at, ranked=False).drop("src"))
        want = rows(bucketing.side_scores(near))
        assert len(want) > 100 and rows(net.partners(at)) == want


def test_trips_are_searched_by_tiles_to_their_ends(spark, located, monkeypatch):
    """Neither the graph nor all nodes within the cutoff are made for trips; without places the plain search gives the same."""
    n, e, edges = located
    rng = random.Random(8)
    place = {r.node_id: (r.lat, r.lng) for r in n.collect()}
    trips = {u: (rng.randrange(70), rng.randrange(70)) for u in range(150)} | {200: (3, 3), 201: (69, 4), 202: (4, 69)}
    off = lambda k: (place[k][0] + 1e-6, place[k][1])
    r = spark.createDataFrame([(u, *place[a], *off(b)) for u, (a, b) in trips.items()], "user_id long, origin_lat double, origin_lng double, destination_lat double, destination_lng double")
    nowhere = n.unionByName(spark.createDataFrame([(500, None, None)], "node_id long, lat double, lng double"))
    plain = {x.user_id: x.dist_m for x in network.walking_distances(r, nowhere, e.unionByName(spark.createDataFrame([(500, 500, 1.0)], e.schema)), 3000.0).collect()}

    def refuse(*_):
        raise AssertionError("all nodes within the cutoff are listed")

    monkeypatch.setattr(network, "shortest", refuse)
    got = {x.user_id: x.dist_m for x in network.walking_distances(r, n, e, 3000.0).collect()}
    assert got == pytest.approx(plain) and len(got) == 153
    reach = {s: dijkstra(edges, s, 3000.0) for s in range(70)}
    hit = {u: reach[a][b] for u, (a, b) in trips.items() if a != b and b in reach[a]}
    assert len(hit) > 20 and {u: got[u] for u in hit} == pytest.approx(hit)


def test_unplaced_nodes_do_not_fit(spark, located):
    n, e, _ = located
    assert not Network(n.where("node_id <> 3"), e, 8, 1500.0).fits
