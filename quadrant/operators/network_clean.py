"""Building a walkable network out of drawn lines.

Crossings of all segments are found by a distributed join on a grid and cut there. Dropping repeated strokes, welding, collapsing corridors, teeing,
repairing junctions, linking, splicing and gates depend on the order in which they are done, so each runs in sequence within one site (one campus's drawing, a few
thousand lines); sites run in parallel. Coordinates are metres.

Defined results: segments of no length and with null ends are dropped; a site of more than MAX_SITE_POINTS points is refused, not cut;
empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.functions import geo
from quadrant.sources.tables import slots

MAX_SITE_POINTS = 500_000


def by_task(frame: DataFrame, key: str) -> DataFrame:
    """Rows spread by key over all slots: sites are few bytes but much work, so they must not be put together by size."""
    return frame.repartition(4 * slots(frame.sparkSession), key)


def _cells(x1: str, y1: str, x2: str, y2: str, size: float) -> F.Column:
    """Grid cells that a segment's box touches."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return F.flatten(F.transform(span(x1, x2), lambda i: F.transform(span(y1, y2), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def cut_at_crossings(segments: DataFrame, cell: float = 50.0) -> DataFrame:
    """(site, id, piece, x1, y1, x2, y2): every segment cut where another of its site meets it.

    A pair is tested in the one cell that holds the lower corner of the overlap of their boxes, so no pair counts twice.
    """
    rows = segments.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null and not (x1 = x2 and y1 = y2)").select("site", "id", "x1", "y1", "x2", "y2")
    placed = rows.withColumn("c", F.explode(_cells("x1", "y1", "x2", "y2", cell)))
    a = placed.select("site", "c", F.col("id").alias("a"), *[F.col(k).alias(f"a{k}") for k in ("x1", "y1", "x2", "y2")])
    b = placed.select("site", "c", F.col("id").alias("b"), *[F.col(k).alias(f"b{k}") for k in ("x1", "y1", "x2", "y2")])
    corner = [F.floor(F.greatest(F.least(f"a{k}1", f"a{k}2"), F.least(f"b{k}1", f"b{k}2")) / cell) for k in ("x", "y")]
    pairs = a.join(b, ["site", "c"]).filter((F.col("a") < F.col("b")) & (F.col("c.i") == corner[0]) & (F.col("c.j") == corner[1]))
    met = pairs.select("site", "a", "b", geo.crossing(*[F.col(c) for c in ("ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2")]).alias("m")).filter("m is not null")
    cuts = met.select("site", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("m.t").alias("t")), F.struct(F.col("b").alias("id"), F.col("m.u").alias("t")))).alias("k")).groupBy("site", F.col("k.id").alias("id")).agg(F.sort_array(F.collect_set(F.round("k.t", 9))).alias("ts"))
    inner = F.filter(F.coalesce("ts", F.array().cast("array<double>")), lambda t: (t > 1e-9) & (t < 1 - 1e-9))
    whole = rows.join(cuts, ["site", "id"], "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))))
    pieces = whole.select("site", "id", "x1", "y1", "x2", "y2", "ts", F.posexplode(F.slice("ts", 1, F.size("ts") - 1)).alias("piece", "t0")).withColumn("t1", F.get("ts", F.col("piece") + 1))
    at = lambda lo, hi, t: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(t)
    return pieces.select("site", "id", "piece", at("x1", "x2", "t0").alias("x1"), at("y1", "y2", "t0").alias("y1"), at("x1", "x2", "t1").alias("x2"), at("y1", "y2", "t1").alias("y2"))


class Site:
    """Nodes and edges of one site, with a grid over the nodes."""

    def __init__(self, tolerance: float) -> None:
        self.tolerance = tolerance
        self.x: list[float] = []
        self.y: list[float] = []
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.edges: dict[tuple[int, int], float] = {}
        self.near: dict[int, set[int]] = defaultdict(set)

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.tolerance), math.floor(y / self.tolerance)

    def node(self, x: float, y: float) -> int:
        """The first node within the tolerance, else a new one."""
        i, j = self._cell(x, y)
        near = [n for a in (-1, 0, 1) for b in (-1, 0, 1) for n in self.cells.get((i + a, j + b), ()) if math.hypot(self.x[n] - x, self.y[n] - y) <= self.tolerance]
        if near:
            return min(near)
        self.x.append(x)
        self.y.append(y)
        self.cells[i, j].append(len(self.x) - 1)
        return len(self.x) - 1

    def join(self, a: int, b: int, width: float) -> None:
        """An edge once for both directions; of parallel ones the widest counts."""
        if a != b:
            key = (min(a, b), max(a, b))
            self.edges[key] = max(self.edges.get(key, width), width)
            self.near[a].add(b)
            self.near[b].add(a)

    def drop(self, edge: tuple[int, int]) -> float:
        """Takes an edge out; its width."""
        self.near[edge[0]].discard(edge[1])
        self.near[edge[1]].discard(edge[0])
        return self.edges.pop(edge)

    def foot(self, n: int, edge: tuple[int, int]) -> tuple[float, float, float]:
        """(distance, x, y) of the nearest point of an edge to a node."""
        (ax, ay), (bx, by) = ((self.x[k], self.y[k]) for k in edge)
        dx, dy = bx - ax, by - ay
        t = min(1.0, max(0.0, ((self.x[n] - ax) * dx + (self.y[n] - ay) * dy) / ((dx * dx + dy * dy) or 1.0)))
        px, py = ax + t * dx, ay + t * dy
        return math.hypot(self.x[n] - px, self.y[n] - py), px, py

    def edges_near(self, n: int, reach: float, index: dict) -> list[tuple[int, int]]:
        """Edges in the cells around a node that do not end at it."""
        i, j = math.floor(self.x[n] / EDGE_CELL), math.floor(self.y[n] / EDGE_CELL)
        r = math.ceil(reach / EDGE_CELL)
        seen = {e for a in range(-r, r + 1) for b in range(-r, r + 1) for e in index.get((i + a, j + b), ())}
        return [e for e in seen if n not in e and e in self.edges]

    def nearest_edge(self, n: int, reach: float, index: dict) -> tuple[float, tuple[int, int], float, float] | None:
        """The nearest edge within reach that does not end at the node; the first of equals."""
        found = [(*self.foot(n, e), e) for e in self.edges_near(n, reach, index)]
        found = [f for f in found if f[0] <= reach]
        if not found:
            return None
        d, px, py, e = min(found, key=lambda f: (f[0], f[3]))
        return d, e, px, py

    def edge_index(self) -> dict[tuple[int, int], list[tuple[int, int]]]:
        index: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for e in self.edges:
            self._enter(index, e)
        return index

    def _enter(self, index: dict, e: tuple[int, int]) -> None:
        xs, ys = sorted(self.x[k] for k in e), sorted(self.y[k] for k in e)
        for i in range(math.floor(xs[0] / EDGE_CELL), math.floor(xs[1] / EDGE_CELL) + 1):
            for j in range(math.floor(ys[0] / EDGE_CELL), math.floor(ys[1] / EDGE_CELL) + 1):
                index[i, j].append(e)

    def attach(self, n: int, edge: tuple[int, int], px: float, py: float, index: dict) -> None:
        """Joins a node to an edge at a point, which splits the edge unless an end is within the tolerance."""
        width = self.edges[edge]
        close = [k for k in edge if math.hypot(self.x[k] - px, self.y[k] - py) <= self.tolerance]
        if close:
            self.join(n, close[0], width)
            self._enter(index, (min(n, close[0]), max(n, close[0])))
            return
        self.x.append(px)
        self.y.append(py)
        middle = len(self.x) - 1
        self.cells[self._cell(px, py)].append(middle)
        self.drop(edge)
        for k in (*edge, n):
            self.join(k, middle, width)
            self._enter(index, (min(k, middle), max(k, middle)))


EDGE_CELL = 25.0


def weld(rows: pd.DataFrame, tolerance: float) -> Site:
    """The site's segments with ends within the tolerance made one node, in the order of the rows."""
    if 2 * len(rows) > MAX_SITE_POINTS:
        raise ValueError("the site is too large to be built in sequence; split it into sites")
    site = Site(tolerance)
    widths = rows["width"] if "width" in rows else [0.0] * len(rows)
    for x1, y1, x2, y2, w in zip(rows["x1"], rows["y1"], rows["x2"], rows["y2"], widths, strict=True):
        site.join(site.node(x1, y1), site.node(x2, y2), float(w))
    return site


def tee(site: Site, reach: float, passes: int = 12) -> int:
    """Ends of lines that stop short of another line are joined to it, pass by pass until nothing changes; how many were."""
    done = 0
    for _ in range(passes):
        degree: dict[int, int] = defaultdict(int)
        for a, b in site.edges:
            degree[a] += 1
            degree[b] += 1
        index, changed = site.edge_index(), 0
        for n in sorted(k for k, d in degree.items() if d == 1):
            found = site.nearest_edge(n, reach, index)
            if found:
                site.attach(n, *found[1:], index)
                changed += 1
        done += changed
        if not changed:
            break
    return done


def splice(site: Site, places: list[tuple[float, float]], reach: float) -> list[int | None]:
    """Joins each place to the nearest edge within reach, one after the other; the node of each, None where none is."""
    index, nodes = site.edge_index(), []
    for x, y in places:
        site.x.append(x)
        site.y.append(y)
        n = len(site.x) - 1
        found = site.nearest_edge(n, reach, index)
        if found:
            site.attach(n, *found[1:], index)
        nodes.append(n if found else None)
    return nodes


def undirected_gap_deg(a: float, b: float) -> float:
    """Degrees between two undirected directions (radians), 0 to 90."""
    gap = abs(a - b) % math.pi
    return math.degrees(min(gap, math.pi - gap))


def cover_share(a: np.ndarray, b: np.ndarray, tolerance: float, angle: float, step: float = 2.0) -> float:
    """Share of a line that runs along another: sampled, near it and about parallel to its nearest segment."""
    start, way = a[:-1], np.diff(a, axis=0)
    length = np.hypot(way[:, 0], way[:, 1])
    n = np.maximum(1, np.floor(length / step + 0.5)).astype(int)
    of = np.repeat(np.arange(len(n)), n)
    t = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[of]
    p = start[of] + t[:, None] * way[of]
    other, theirs = b[:-1], np.diff(b, axis=0)
    size = (theirs**2).sum(axis=1)
    u = np.clip(((p[:, None] - other[None]) * theirs[None]).sum(axis=2) / np.where(size == 0, 1.0, size), 0, 1)
    away = np.hypot(*np.moveaxis(p[:, None] - other[None] - u[..., None] * theirs[None], 2, 0))
    at = away.argmin(axis=1)
    gap = np.abs(np.arctan2(way[of, 1], way[of, 0]) - np.arctan2(theirs[at, 1], theirs[at, 0])) % math.pi
    fits = (away[np.arange(len(at)), at] <= tolerance) & (np.degrees(np.minimum(gap, math.pi - gap)) <= angle)
    return float(fits.mean()) if len(fits) else 0.0


def without_repeats(strokes: list[tuple[int, np.ndarray]], tolerance: float = 3.0, angle: float = 20.0, cover: float = 0.7, tail: float = 4.0) -> list[int]:
    """Indices of the strokes that stay. Taken by rank, then length; one is dropped if a kept one covers enough of it, unless what is left over is a tail of its own."""
    length = [float(np.hypot(*np.diff(p, axis=0).T).sum()) for _, p in strokes]
    boxes = [(p.min(axis=0) - tolerance, p.max(axis=0) + tolerance) for _, p in strokes]
    kept: list[int] = []
    for i in sorted(range(len(strokes)), key=lambda k: (strokes[k][0], -length[k])):
        if not length[i]:
            continue
        near = [k for k in kept if (boxes[k][0] <= boxes[i][1]).all() and (boxes[i][0] <= boxes[k][1]).all()]
        most = max((cover_share(strokes[i][1], strokes[k][1], tolerance, angle) for k in near), default=0.0)
        if most < cover or length[i] * (1 - most) >= tail:
            kept.append(i)
    return kept


def neighbours(site: Site) -> dict[int, list[int]]:
    found: dict[int, list[int]] = defaultdict(list)
    for a, b in site.edges:
        found[a].append(b)
        found[b].append(a)
    return found


def distances_from(site: Site, start: int, cap: float) -> dict[int, float]:
    """Lengths of shortest ways; nodes beyond the cap are not gone on from, but keep the length at which they were reached."""
    near, found, heap = site.near, {start: 0.0}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > found[n] or d > cap:
            continue
        for m in near[n]:
            far = d + math.hypot(site.x[n] - site.x[m], site.y[n] - site.y[m])
            if far < found.get(m, math.inf):
                found[m] = far
                heapq.heappush(heap, (far, m))
    return found


def unite(site: Site, a: int, b: int, wide_a: float = 1.0, wide_b: float = 1.0) -> None:
    """Makes b the same node as a: in the middle if they are about as wide, else where the wider one is."""
    share = 0.5 if abs(wide_a - wide_b) <= 0.1 * max(wide_a, wide_b) else 0.0 if wide_a > wide_b else 1.0
    site.x[a] += share * (site.x[b] - site.x[a])
    site.y[a] += share * (site.y[b] - site.y[a])
    for m in sorted(site.near[b]):
        site.join(a, m, site.drop((min(b, m), max(b, m))))


def _meet(site: Site, n: int, edge: tuple[int, int], wide: float) -> bool:
    """Brings a node onto an edge: onto its end if that is within the tolerance, else onto the foot, which splits the edge."""
    if edge not in site.edges or n in edge or not site.near[n]:
        return False
    width = site.edges[edge]
    _, px, py = site.foot(n, edge)
    for end in edge:
        if math.hypot(site.x[end] - px, site.y[end] - py) < site.tolerance:
            unite(site, n, end, wide, width)
            return True
    site.drop(edge)
    site.x.append(px)
    site.y.append(py)
    middle = len(site.x) - 1
    for end in edge:
        site.join(end, middle, width)
    unite(site, n, middle, wide, width)
    return True


def collapse(site: Site, least: float = 3.0, most: float = 5.0, angle: float = 20.0, passes: int = 8) -> int:
    """Corridors drawn twice become one: each node is brought onto the nearest edge that runs about its own way and is within half the sum of their widths
    (between ``least`` and ``most``), nearest first, pass by pass."""
    done = 0
    for _ in range(passes):
        near, index, wanted = neighbours(site), site.edge_index(), []
        for n in sorted(near):
            wide = max(1.0, *(site.edges[min(n, m), max(n, m)] for m in near[n]))
            own = [math.atan2(site.y[m] - site.y[n], site.x[m] - site.x[n]) for m in near[n]]
            best = None
            for e in site.edges_near(n, most, index):
                d, _, _ = site.foot(n, e)
                theirs = math.atan2(site.y[e[1]] - site.y[e[0]], site.x[e[1]] - site.x[e[0]])
                if d <= min(most, max(least, (wide + site.edges[e]) / 2)) and (best is None or (d, e) < best) and any(undirected_gap_deg(o, theirs) <= angle for o in own):
                    best = (d, e)
            if best:
                wanted.append((best[0], n, best[1], wide))
        changed = sum(_meet(site, n, e, wide) for _, n, e, wide in sorted(wanted))
        done += changed
        if not changed:
            break
    return done


def repair_junctions(site: Site, reach: float = 6.0, ratio: float = 6.0, passes: int = 8) -> int:
    """Nodes that lie by an edge but are a long way round from both its ends are brought onto it, nearest first."""
    done = 0
    for _ in range(passes):
        index, wanted = site.edge_index(), []
        for n in sorted(neighbours(site)):
            best = min(((site.foot(n, e)[0], e) for e in site.edges_near(n, reach, index)), default=None)
            if best is None or best[0] > reach:
                continue
            bound = ratio * max(best[0], 1.0)
            around = distances_from(site, n, bound + 1)
            if min(around.get(k, math.inf) for k in best[1]) > bound:
                wanted.append((best[0], n, best[1]))
        changed = sum(_meet(site, n, e, 1.0) for _, n, e in sorted(wanted))
        done += changed
        if not changed:
            break
    return done


def attach_point(site: Site, x: float, y: float, reach: float) -> int:
    """The nearest node within the tolerance (of equals the last), else the foot on the nearest edge within reach, else a node of its own."""
    used = set().union(*site.edges) if site.edges else set()
    near = [(math.hypot(site.x[k] - x, site.y[k] - y), -k) for k in used]
    best = min(near, default=(math.inf, 0))
    if best[0] <= site.tolerance:
        return -best[1]
    site.x.append(x)
    site.y.append(y)
    n = len(site.x) - 1
    found = min(((*site.foot(n, e), e) for e in site.edges), default=None)
    if found is None or found[0] > reach:
        return n
    width = site.drop(found[3])
    site.x[n], site.y[n] = found[1], found[2]
    for end in found[3]:
        site.join(end, n, width)
    return n


def link(site: Site, lines: list[list[tuple[float, float]]], reach: float = 3.0) -> int:
    """Adds lines drawn by hand, each point attached to what is there; how many were."""
    done = 0
    for line in lines:
        if len(line) > 1:
            nodes = [attach_point(site, x, y, reach) for x, y in line]
            for a, b in zip(nodes, nodes[1:], strict=False):
                site.join(a, b, 1.0)
            done += 1
    return done


def gates(site: Site, own: set[int], ways: dict[tuple[int, int], str], reach: float = 12.0, touch: float = 2.0, detour: float = 250.0) -> list[tuple[int, float]]:
    """(node, metres) of the connectors made between nodes of one network and edges of another, nearest first; one farther than ``touch`` is only made where
    there is no way of ``detour`` round already. ``ways`` tells each edge's origin and is kept up to date: the first to draw an edge owns it."""
    found = []
    for n in sorted(own):
        best = min(((*site.foot(n, e), e) for e, origin in ways.items() if origin != "own" and n not in e), default=None)
        if best and best[0] <= reach:
            found.append((best[0], n, best[3]))
    made = []
    for d, n, edge in sorted(found):
        if edge not in site.edges:
            continue
        if d > touch:
            around = distances_from(site, n, detour)
            if min(around.get(k, math.inf) for k in edge) <= detour:
                continue
        _, px, py = site.foot(n, edge)
        target = next((k for k in edge if math.hypot(site.x[k] - px, site.y[k] - py) < site.tolerance), None)
        if target is None:
            target = site.node(px, py)
            width, origin = site.drop(edge), ways.pop(edge)
            for end in edge:
                if end != target:
                    site.join(end, target, width)
                    ways.setdefault((min(end, target), max(end, target)), origin)
        site.join(n, target, 1.0)
        ways.setdefault((min(n, target), max(n, target)), "gate")
        made.append((n, d))
    return made


def detours(site: Site, within: float = 30.0, times: float = 4.0) -> list[tuple[int, int, float, float]]:
    """(a, b, apart, through) of nodes near each other that are more than ``times`` as far through the network; through is infinite where no way joins them."""
    nodes, cells = sorted(set().union(*site.edges)) if site.edges else [], defaultdict(list)
    for n in nodes:
        cells[math.floor(site.x[n] / within), math.floor(site.y[n] / within)].append(n)
    found = []
    for n in nodes:
        i, j = math.floor(site.x[n] / within), math.floor(site.y[n] / within)
        near = [m for a in (-1, 0, 1) for b in (-1, 0, 1) for m in cells.get((i + a, j + b), ()) if m > n]
        near = [(m, d) for m in near if 0 < (d := math.hypot(site.x[n] - site.x[m], site.y[n] - site.y[m])) <= within]
        if near:
            through = distances_from(site, n, within * times)
            found += [(n, m, d, through.get(m, math.inf)) for m, d in near if through.get(m, math.inf) > times * d]
    return found


def emitted(site: Site, places: int = 7) -> list[tuple[int, int, float, float, float, float, float]]:
    """(from, to, x1, y1, x2, y2, width) with dense node numbers in the order of the kept ones; edges without length after rounding are left out."""
    dense = {n: i for i, n in enumerate(sorted(set().union(*site.edges)))} if site.edges else {}
    at = lambda n: (round(site.x[n], places), round(site.y[n], places))
    return sorted((dense[a], dense[b], *at(a), *at(b), w) for (a, b), w in site.edges.items() if at(a) != at(b))


def largest_part(site: Site) -> None:
    """Keeps only the edges of the component with the most nodes, of equals the one with the least node."""
    near, left, best = neighbours(site), set(), set()
    for n in sorted(near):
        if n in left:
            continue
        part, waiting = {n}, [n]
        while waiting:
            for m in near[waiting.pop()]:
                if m not in part:
                    part.add(m)
                    waiting.append(m)
        left |= part
        if len(part) > len(best):
            best = part
    for edge in [e for e in site.edges if e[0] not in best]:
        site.drop(edge)


NETWORK = "from_node long, to_node long, x1 double, y1 double, x2 double, y2 double, width double"


def build_network(pieces: DataFrame, weld_m: float = 2.0, tee_m: float = 3.0, whole: bool = False) -> DataFrame:
    """(site, from_node, to_node, x1, y1, x2, y2, width): each site's pieces welded, collapsed, teed and repaired, nodes numbered densely; ``whole`` keeps only the
    largest part."""
    kind = dict(pieces.dtypes)["site"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        site = weld(rows.sort_values(["id", "piece"]), weld_m)
        collapse(site)
        tee(site, tee_m)
        repair_junctions(site)
        if whole:
            largest_part(site)
        return pd.DataFrame([(key[0], *e) for e in emitted(site)], columns=["site", "from_node", "to_node", "x1", "y1", "x2", "y2", "width"])

    return by_task(pieces, "site").groupBy("site").applyInPandas(run, f"site {kind}, {NETWORK}")


def kept_strokes(strokes: DataFrame) -> DataFrame:
    """(site, id) of the strokes (site, id, rank, points) of each site that no other stroke repeats."""
    kind = dict(strokes.dtypes)["site"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        lines = [(int(r), np.array([(p["x"], p["y"]) for p in pts], float)) for r, pts in zip(rows["rank"], rows["points"], strict=True)]
        return pd.DataFrame({"site": key[0], "id": rows["id"].to_numpy()[sorted(without_repeats(lines))]})

    return by_task(strokes.filter("size(points) > 1"), "site").groupBy("site").applyInPandas(run, f"site {kind}, id long")


def greedy_spacing(frame: DataFrame, group: str, order: str, x: str, y: str, apart: float) -> DataFrame:
    """(group, order): rows taken in order if none taken before in their group is nearer than ``apart``. Sequential within a group by nature.

    Rows that must not be taken (a mark stands in them already) are left out of ``frame`` by an anti join before.
    """
    kind = dict(frame.dtypes)[group]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple[int, int], list[tuple[float, float]]] = defaultdict(list)
        taken = []
        for o, px, py in rows.dropna().sort_values(order)[[order, x, y]].itertuples(index=False):
            i, j = math.floor(px / apart), math.floor(py / apart)
            if all(math.hypot(px - qx, py - qy) >= apart for a in (-1, 0, 1) for b in (-1, 0, 1) for qx, qy in cells.get((i + a, j + b), ())):
                cells[i, j].append((px, py))
                taken.append((key[0], o))
        return pd.DataFrame(taken, columns=[group, order])

    return by_task(frame.select(group, order, x, y), group).groupBy(group).applyInPandas(run, f"{group} {kind}, {order} long")
