import random

import numpy as np
import pytest

from quadrant.functions.sphere import great_circle, inside_rings
from quadrant.operators.nearest import nearest_join, nearest_within, without_near
from quadrant.operators.vantage_tree import VantageTree
from quadrant.operators.voronoi_join import Near, Within, voronoi_join

POINT = "id long, lon double, lat double, cell string, role string"


def points(seed, n, around=(10.0, 50.0), spread=0.01):
    rng = random.Random(seed)
    return [(i, around[0] + rng.gauss(0, spread), around[1] + rng.gauss(0, spread), "x", None) for i in range(n)]


def brute(a, b, metres):
    found = set()
    for i, x, y, *_ in a:
        for j, u, v, *_ in b:
            if None not in (x, y, u, v) and abs(x) <= 180 and abs(y) <= 90 and abs(u) <= 180 and abs(v) <= 90 and great_circle(*np.radians([x, y, u, v])) <= metres:
                found.add((i, j))
    return found


@pytest.mark.parametrize("cell_points", [10, 100_000])
def test_radius_join_is_complete(spark, cell_points):
    bad = [(900, None, 50.0, "x", None), (901, float("nan"), 50.0, None, None), (902, 200.0, 50.0, "x", None), (903, 10.0, 95.0, "x", None)]
    a = points(1, 150) + bad + [(300 + i, 10.0, 50.0, "x", None) for i in range(40)] + [(400, 180.0, 10.0, "x", None)]
    b = points(2, 200) + bad + [(500 + i, 10.0, 50.0, "x", None) for i in range(40)] + [(600, -180.0, 10.0, "x", None)]
    sets = {"a": (spark.createDataFrame(a, POINT), "id"), "b": (spark.createDataFrame(b, POINT), "id")}
    got = voronoi_join(spark, sets, [Near("ab", "a", "b", 300), Near("aa", "a", "a", 200)], cell_points=cell_points).collect()
    pairs = [tuple(r) for r in got]
    assert len(pairs) == len(set(pairs))
    assert {p[1:] for p in pairs if p[0] == "ab"} == brute(a, b, 300)
    assert (400, 600) in {p[1:] for p in pairs if p[0] == "ab"}
    assert {p[1:] for p in pairs if p[0] == "aa"} == {(i, j) for i, j in brute(a, a, 200) if i < j}


@pytest.mark.parametrize("cell_points", [10, 100_000])
def test_regions(spark, cell_points):
    ring = lambda x, y, r, n=9: [(x + r * np.cos(t), y + r * np.sin(t)) for t in np.linspace(0, 2 * np.pi, n)]
    outlines = [(1, [ring(10, 50, 0.01)]), (2, [ring(10, 50, 0.02), ring(10, 50, 0.005)]), (3, [ring(10.02, 50, 0.5)]), (4, []), (5, None), (6, [[(10.0, 50.0)]])]
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in rings] if rings is not None else None) for i, rings in outlines]
    regions = spark.createDataFrame(rows, "boundary_id long, rings array<array<struct<lon:double,lat:double>>>")
    a = points(3, 200) + [(700, None, None, None, None)]
    got = voronoi_join(spark, {"a": (spark.createDataFrame(a, POINT), "id")}, [], {"r": (regions, "boundary_id")}, [Within("in", "a", "r")], cell_points).collect()
    want = set()
    for b, rings in outlines[:3]:
        inside = inside_rings(np.array([p[1] for p in a[:-1]]), np.array([p[2] for p in a[:-1]]), [np.array(r) for r in rings])
        want |= {(p[0], b) for p, k in zip(a, inside, strict=False) if k}
    assert {(r[1], r[2]) for r in got} == want


def test_empty(spark):
    none = spark.createDataFrame([], POINT)
    some = spark.createDataFrame(points(1, 3), POINT)
    assert voronoi_join(spark, {"a": (none, "id"), "b": (some, "id")}, [Near("x", "a", "b", 10)]).count() == 0
    assert nearest_join(some, "id", none, "id").count() == 0
    assert without_near(some, "id", none, "id", 10).count() == 3


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_nearest(spark, block):
    a, b = points(4, 100), points(5, 120) + [(900, None, 1.0, None, None), (1000, 10.0, 50.0, "", ""), (1001, 10.0, 50.0, "", "")]
    a.append((950, 10.0, 50.0, "", ""))
    got = {r["query_id"]: (r["target_id"], r["metres"]) for r in nearest_join(spark.createDataFrame(a, POINT), "id", spark.createDataFrame(b, POINT), "id", block).collect()}
    for i, x, y, *_ in a:
        want = min((float(great_circle(*np.radians([x, y, u, v]))), j) for j, u, v, *_ in b if u is not None)
        assert got[i][0] == want[1] and abs(got[i][1] - want[0]) < 1e-6
    assert got[950][0] == 1000
    assert nearest_within(spark.createDataFrame(a, POINT), "id", spark.createDataFrame(b, POINT), "id", 0.001).count() == 1


def test_tree_with_many_equal_points():
    tree = VantageTree(np.zeros(5000), np.zeros(5000))
    pairs = sum(len(q) for q, _ in tree.within(np.zeros(3), np.zeros(3), 1.0))
    assert pairs == 15_000


def test_nearest_in_cells_equals_the_held_tree(spark):
    bad = [(900, None, 50.0, "x", None), (902, 200.0, 50.0, "x", None)]
    a = points(3, 200) + bad + [(300 + i, 10.0, 50.0, "x", None) for i in range(60)] + [(300, 10.0, 50.0, "x", None), (401, 10.3, 50.2, "x", None)]
    b = points(4, 250) + bad + [(500 + i, 10.0005, 50.0, "x", None) for i in range(60)]
    one, other = spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT)
    want = sorted(tuple(r) for r in nearest_join(one, "id", other, "id").collect())
    got = sorted(tuple(r) for r in nearest_join(one, "id", other, "id", held_points=0, cell_points=10).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == len(a) - 2
    assert max(abs(x[2] - y[2]) for x, y in zip(got, want, strict=True)) < 1e-6
    assert nearest_join(one, "id", other.limit(0), "id", held_points=-1).count() == 0


def test_places_with_their_counts_stand_for_all_pairs(spark):
    from quadrant.operators.voronoi_join import joined_places

    a = points(5, 60) + [(100 + i, 10.0, 50.0, "x", None) for i in range(30)]
    b = points(6, 60) + [(200 + i, 10.0, 50.0, "x", None) for i in range(20)]
    sets = {"a": (spark.createDataFrame(a, POINT), "id"), "b": (spark.createDataFrame(b, POINT), "id")}
    near = [Near("ab", "a", "b", 300), Near("aa", "a", "a", 200)]
    rows = joined_places(spark, sets, near, cell_points=20).collect()
    ab = sum(r["points"] * r["others"] for r in rows if r["rel"] == "ab")
    aa = sum(r["points"] * (r["points"] - 1) // 2 if r["place_id"] == r["other_id"] else r["points"] * r["others"] for r in rows if r["rel"] == "aa")
    assert ab == len(brute(a, b, 300)) and aa == len({p for p in brute(a, a, 200) if p[0] < p[1]})
    assert [r["points"] for r in rows if r["rel"] == "aa" and r["place_id"] == 100 and r["other_id"] == 100] == [30]
