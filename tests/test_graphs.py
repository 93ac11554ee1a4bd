import heapq
import random

import pytest

from quadrant.operators import graphs, routing, swept_paths


@pytest.mark.parametrize("local_edges", [0, 1_000_000])
def test_components_of_chains_and_loops(spark, local_edges):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 3), (5, None)]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "src long, dst long"), local_edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}
    assert graphs.components(spark.createDataFrame([], "src long, dst long"), local_edges).count() == 0


def test_which_component_is_kept(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    assert graphs.largest_component(edges).count() == 61
    assert sorted(r["node"] for r in graphs.component_of(edges, 101).collect()) == [100, 101]
    assert graphs.component_of(edges, 500).count() == 0


def test_components_of_a_long_path_and_a_grid_with_random_ids(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10**9), 100_000)
    path = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")
    # All but the first 2,000 edges are contracted by distributed rounds.
    rows = graphs.components(path, 2_000).agg({"component": "max", "node": "count"}).first()
    assert tuple(rows) == (min(ids), 100_000) or tuple(rows) == (100_000, min(ids))
    n = 316
    ids = rng.sample(range(10**9), n * n)
    grid = [(ids[i * n + j], ids[i * n + j + 1]) for i in range(n) for j in range(n - 1)] + [(ids[i * n + j], ids[(i + 1) * n + j]) for i in range(n - 1) for j in range(n)]
    found = graphs.components(spark.createDataFrame(grid, "src long, dst long"))
    assert found.select("component").distinct().collect()[0][0] == min(ids)
    assert found.count() == n * n


def test_hot_keys_join_to_the_same_rows(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(50)]
    monkeypatch.setattr(graphs, "HOT_PART", 10**9)
    monkeypatch.setattr(graphs, "max", lambda *_: 20, raising=False)
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "src long, dst long"), 0).collect()}
    assert got == {**dict.fromkeys(range(400), 0), **dict.fromkeys(range(1000, 1051), 1000)}


def dijkstra(near, start):
    best, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, w in near.get(n, ()):
                heapq.heappush(heap, (d + w, m))
    return best


@pytest.mark.parametrize("local_edges", [0, 1_000_000])
def test_distances_match_dijkstra(spark, local_edges):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 9))) for _ in range(90)]
    near = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    best = dijkstra(near, 0)
    frame = spark.createDataFrame([*edges, (None, 1, 1.0), (1, 2, None)], "src long, dst long, w double")
    start = spark.createDataFrame([(0,), (77,)], "node long")
    got = {(r["source"], r["node"]): r["dist"] for r in graphs.shortest_distances(frame, start, local_edges=local_edges).collect()}
    assert got == {**{(0, n): d for n, d in best.items()}, (77, 77): 0.0}
    one = spark.createDataFrame([(0,)], "node long")
    capped = {r["node"]: r["dist"] for r in graphs.shortest_distances(frame, one, 8.0, local_edges=local_edges).collect()}
    assert capped == {n: d for n, d in best.items() if d <= 8}
    past = {r["node"]: r["dist"] for r in graphs.shortest_distances(frame, one, 3.0, True, local_edges).collect()}
    inside = {n: d for n, d in best.items() if d <= 3}
    beyond = {}
    for n, d in inside.items():
        for m, w in near.get(n, ()):
            if m not in inside:
                beyond[m] = min(beyond.get(m, 1e9), d + w)
    assert past == {**inside, **beyond}
    for r in graphs.shortest_tree(frame, one, local_edges).collect():
        fits = [m for m, w in near[r["node"]] if abs(best[m] + w - r["dist"]) < 1e-9]
        assert r["parent"] == (min(fits) if r["node"] else None)


def test_route_answers_every_request(spark):
    step = 0.001
    vertices = [(i, step * (i % 4), step * (i // 4), "x") for i in range(12)] + [(20, 0.1, 0.1, "x"), (21, 0.101, 0.1, "x"), (22, None, None, "x")]
    edges = [(i, i + 1, 111.195) for i in range(12) if i % 4 < 3] + [(i, i + 4, 111.195) for i in range(8)] + [(20, 21, 111.0)]
    asked = [(1, 0.0, 0.0, 0.003, 0.002), (2, 0.0, 0.0, 0.1, 0.1), (3, 5.0, 5.0, 0.0, 0.0), (4, 0.0, 0.0, 5.0, 5.0), (5, 0.0, 0.0, 0.0001, 0.0), (6, None, 0.0, 0.0, 0.0), (7, 0.0, 95.0, 0.0, 0.0), (8, 5.0, 5.0, 6.0, 6.0)]
    found = routing.route(spark.createDataFrame(asked, "req long, from_lon double, from_lat double, to_lon double, to_lat double"), spark.createDataFrame(vertices, "vid long, lon double, lat double, req string"), spark.createDataFrame(edges, "src long, dst long, w double"))
    rows = {r["req"]: r for r in found.collect()}
    assert {k: (r["status"], r["which"]) for k, r in rows.items()} == {1: ("ok", None), 2: ("no-path", None), 3: ("unreachable", "start"), 4: ("unreachable", "end"), 5: ("same-place", None), 6: ("bad-coordinate", None), 7: ("bad-coordinate", None), 8: ("unreachable", "start")}
    walk = rows[1]
    assert walk["path"][0] == 0 and walk["path"][-1] == 11 and len(walk["path"]) == 6
    assert walk["feet"] == round(5 * 111.195 * 3.28084)
    assert [m["type"] for m in walk["maneuvers"]][0] == "depart" and walk["maneuvers"][-1]["type"] == "arrive"
    assert abs(sum(m["feet"] for m in walk["maneuvers"]) - walk["feet"]) <= len(walk["maneuvers"])
    assert walk["from_feet"] is None and rows[5]["feet"] is None


def test_turn_boundaries():
    import numpy as np

    assert routing.turn_names(np.array([19.9, 20.0, -60.0, 60.1, 150.0, 150.1, -150.0])) == ["straight", "slight-right", "slight-left", "right", "right", "uturn", "left"]


@pytest.fixture(scope="module")
def walks(spark):
    """A grid with gaps and many equally long ways, nodes without an edge, and requests between all kinds of places."""
    rng = random.Random(9)
    at = {i: (0.001 * (i % 9) + rng.uniform(0, 4e-4), 0.001 * (i // 9) + rng.uniform(0, 4e-4)) for i in range(180)}
    edges = [(i, i + 1, 1.0 + i % 3) for i in range(180) if i % 9 < 8 and i % 7 != 3] + [(i, i + 9, 1.5 + i % 2) for i in range(171) if i % 4 != 1 and i // 9 != 9]
    asked = [(k, *at[rng.randrange(180)], *at[rng.randrange(180)]) for k in range(400)] + [(900, None, 0.0, 0.0, 0.0), (901, 5.0, 5.0, 0.0, 0.0)]
    frames = [(asked, "req long, from_lon double, from_lat double, to_lon double, to_lat double"), ([(i, *p) for i, p in at.items()], "vid long, lon double, lat double"), (edges, "src long, dst long, w double")]
    frames = [spark.createDataFrame(*f).cache() for f in frames]
    return frames, routing.route(*frames).collect()


def test_statuses_need_no_search(spark, walks, monkeypatch):
    frames, told = walks
    monkeypatch.setattr(graphs.Adjacency, "paths", None)
    assert {tuple(r) for r in routing.route_statuses(*frames).collect()} == {(r["req"], r["status"], r["which"]) for r in told}
    assert len({r["status"] for r in told}) == 5


@pytest.mark.parametrize("swept", [True, False])
def test_lengths_are_those_of_the_paths(spark, walks, swept, monkeypatch):
    frames, told = walks
    if not swept:
        monkeypatch.setattr(swept_paths, "MOST_NEAR", 0)
    columns = ["req", "status", "which", "start", "finish", "feet", "from_feet", "to_feet"]
    assert {tuple(r) for r in routing.route_lengths(*frames).select(columns).collect()} == {tuple(r[c] for c in columns) for r in told}


@pytest.mark.parametrize("swept", [True, False])
def test_turns_counted_while_walking_are_those_of_the_paths(spark, walks, swept, monkeypatch):
    frames, told = walks
    if not swept:
        monkeypatch.setattr(swept_paths, "MOST_NEAR", 0)
    want = {}
    for m in (m for r in told if r["status"] == "ok" for m in r["maneuvers"]):
        n, feet = want.get(m["type"], (0, 0))
        want[m["type"]] = n + 1, feet + m["feet"]
    assert {r["type"]: (r["turns"], r["feet"]) for r in routing.turn_totals(*frames).collect()} == want and len(want) == 6
