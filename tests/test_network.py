import math

import numpy as np

from quadrant.operators import network_clean as nc


def site(lines, tolerance=2.0):
    made = nc.Site(tolerance)
    for x1, y1, x2, y2, *w in lines:
        made.join(made.node(x1, y1), made.node(x2, y2), w[0] if w else 1.0)
    return made


def test_repeated_strokes_are_dropped_unless_they_go_on():
    line = lambda *p: np.array(p, float)
    strokes = [(0, line((0, 0), (100, 0))), (1, line((10, 1), (60, 1))), (1, line((50, 0), (50, 40))), (1, line((0, 1.5), (110, 1.5))), (0, line((0, 30), (100, 30))), (2, line((5, 5), (5, 5)))]
    assert sorted(nc.without_repeats(strokes)) == [0, 2, 3, 4]


def test_cover_is_a_share_of_the_length():
    a, b = np.array([(0, 0), (100, 0)], float), np.array([(0, 1), (50, 1)], float)
    assert abs(nc.cover_share(a, b, 3.0, 20.0) - 0.52) < 0.03 and nc.cover_share(b, a, 3.0, 20.0) == 1.0
    assert nc.cover_share(a, np.array([(50, -50), (50, 50)], float), 3.0, 20.0) == 0.0


def test_parallel_corridors_collapse():
    made = site([(0, 0, 50, 0, 2), (50, 0, 100, 0, 2), (0, 3, 50, 3, 2), (50, 3, 100, 3, 2), (0, 40, 100, 40)])
    nc.collapse(made)
    near = {n for e in made.edges for n in e if made.y[n] < 10}
    assert len(near) < 6 and any(made.y[a] == 40 for a, _ in made.edges)


def test_a_junction_is_repaired_only_if_the_way_round_is_long():
    lines = [(0, 0, 100, 0), (50, 4, 50, 60)]
    made = site(lines)
    assert nc.repair_junctions(made) == 1
    nodes = nc.distances_from(made, made.node(0, 0), 1e9)
    assert max(nodes.values()) > 100
    joined = site([*lines, (50, 4, 60, 2), (60, 2, 100, 0)])
    before = dict(joined.edges)
    assert nc.repair_junctions(joined, ratio=1e6) == 0 and joined.edges == before


def test_links_attach_to_nodes_edges_or_nothing():
    made = site([(0, 0, 100, 0)])
    assert nc.link(made, [[(50, 1), (50, 30)], [(0, 1), (0, 20)], [(3, 3)]]) == 2
    found = nc.distances_from(made, made.node(0, 0), 1e9)
    assert len(found) == len(set().union(*made.edges)) == 5


def test_gates_skip_what_is_joined_already():
    made = site([(0, 0, 0, 100), (8, -10, 8, 110), (200, 0, 200, 50)])
    own = {made.node(0, 0), made.node(0, 100), made.node(200, 0)}
    ways = {e: "own" if set(e) <= own | {made.node(200, 50)} else "osm" for e in made.edges}
    gates = nc.gates(made, own, ways)
    assert [round(d) for _, d in gates] == [8] and "gate" in ways.values()
    assert len(nc.gates(made, {made.node(0, 0)}, ways, detour=0.0)) <= 1


def test_detours_and_emitted_numbers():
    made = site([(0, 0, 0, 100), (10, 0, 10, 100), (0, 100, 10, 100)])
    found = {(a, b): through / apart for a, b, apart, through in nc.detours(made, within=12.0)}
    assert list(found) == [(0, 2)] and found[0, 2] == math.inf or found[0, 2] > 4
    rows = nc.emitted(made)
    assert {r[0] for r in rows} | {r[1] for r in rows} == {0, 1, 2, 3} and rows == sorted(rows)
    made.join(made.node(500, 500), made.node(520, 500), 1.0)
    nc.largest_part(made)
    assert len(made.edges) == 3


def test_distances_keep_what_lies_one_edge_beyond_the_cap():
    made = site([(0, 0, 10, 0), (10, 0, 30, 0), (30, 0, 60, 0)])
    assert sorted(nc.distances_from(made, 0, 15).values()) == [0, 10, 30]


def test_build_network_over_sites(spark):
    rows = [("a", 1, 0, 0.0, 0.0, 50.0, 0.0, 1.0), ("a", 2, 0, 25.0, 2.5, 25.0, 40.0, 1.0), ("b", 1, 0, 0.0, 0.0, 10.0, 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "site string, id long, piece int, x1 double, y1 double, x2 double, y2 double, width double")
    found = nc.build_network(frame).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in found} == {"a": 4, "b": 1}
    lines = spark.createDataFrame([("a", i, r, [(float(x), float(y)) for x, y in p]) for i, r, p in ((1, 0, [(0, 0), (90, 0)]), (2, 1, [(10, 1), (50, 1)]), (3, 1, [(0, 9), (9, 9)]))], "site string, id long, rank int, points array<struct<x:double,y:double>>")
    assert sorted(r["id"] for r in nc.kept_strokes(lines).collect()) == [1, 3]
