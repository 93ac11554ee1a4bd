"""Complete radius joins and point-in-region joins on a sphere.

Space is cut into the Voronoi cells of pivots taken from the points themselves, so cells are small where points
are dense. A target stays in the cell of its nearest pivot; a query goes to every cell that can hold a target
within its radius. By the triangle inequality those are the cells j with d(q, pj) <= d(q, pi) + 2 r, where
i is the query's own cell. Regions travel the same way as balls around their outline. One shuffle brings each cell
together, and a vantage-point tree with exact great-circle distances finds the pairs in it.

Cells that the sample shows to be large (copies of one place, say a default coordinate) are cut into a grid of
blocks: targets are spread over the rows of the grid, queries over its columns, and each pair of them meets in one block.

Defined results: a null, NaN or out-of-range coordinate gives no rows; repeated rows and points at one place pair
like any others; a pair within one set is given once, smaller id first; an outline with fewer than three corners contains nothing; empty
tables give no rows; other columns are ignored. The pivots are picked by a hash of the id, so results and work repeat exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.sphere import EARTH_M, great_circle, inside_rings
from quadrant.operators.vantage_tree import VantageTree
from quadrant.sources.tables import slots

CELL_POINTS = 20_000
#: Bounds of what is gathered on the driver and broadcast: pivots, and the sample they and the cells' sizes come from (SAMPLE_EACH a pivot, within bounds).
MAX_PIVOTS = 32_768
LEAST_SAMPLE, SAMPLE, SAMPLE_EACH = 32_768, 262_144, 8
#: Metres added to replication bounds; covers the rounding of distances to pivots.
SLACK_M = 1.0
ROUTED = "cell long, role int, source int, id long, lon double, lat double, rings array<array<struct<lon:double,lat:double>>>"
TARGET, QUERY, REGION = 0, 1, 2


@dataclass
class Near:
    """Pairs of ``query`` and ``target`` rows at most ``metres`` apart; both may be the same set."""

    name: str
    query: str
    target: str
    metres: float


@dataclass
class Within:
    """Rows of ``point`` inside an outline of ``region``."""

    name: str
    point: str
    region: str


@dataclass
class Layout:
    """Pivots, and how many target rows and query columns each cell's grid of blocks has.

    Pivots are searched by a vantage-point tree of their own, so a point is compared with a few of them, not with all.
    """

    lon: np.ndarray
    lat: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    base: np.ndarray = field(init=False)
    tree: VantageTree = field(init=False)

    def __post_init__(self) -> None:
        self.base = np.r_[0, np.cumsum(self.rows * self.columns)]
        self.tree = VantageTree(self.lon, self.lat)

    def cells_within(self, lon: np.ndarray, lat: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point index, cell) of all pivots within each point's own distance."""
        found = list(self.tree.within(lon, lat, metres))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def target_blocks(self, home: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, block): a target goes to every column of its row."""
        wide = self.columns[home]
        who = np.repeat(np.arange(len(home)), wide)
        column = np.arange(len(who)) - np.repeat(np.cumsum(wide) - wide, wide)
        at = home[who]
        return who, self.base[at] + (spot[who] % self.rows[at].astype(np.uint64)).astype(np.int64) * self.columns[at] + column

    def query_blocks(self, cell: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, block): a query goes to every row of its column."""
        tall = self.rows[cell]
        who = np.repeat(np.arange(len(cell)), tall)
        row = np.arange(len(who)) - np.repeat(np.cumsum(tall) - tall, tall)
        at = cell[who]
        return who, self.base[at] + row * self.columns[at] + (spot[who] % self.columns[at].astype(np.uint64)).astype(np.int64)


def spots(ids: np.ndarray) -> np.ndarray:
    """A fixed scattered number of each id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def usable(frame: DataFrame, id_column: str, source: int) -> DataFrame:
    """(source, id, lon, lat) of the rows whose coordinates are in range."""
    lon, lat = frame["lon"].cast("double"), frame["lat"].cast("double")
    return frame.select(F.lit(source).alias("source"), frame[id_column].cast("long").alias("id"), lon.alias("lon"), lat.alias("lat")).filter("lon between -180 and 180 and lat between -90 and 90")


def plan_layout(points: DataFrame, queries: set[int], targets: set[int], cell_points: int, pivots_from: int | None = None) -> Layout:
    """Pivots and block grids from one counting pass and a sample of at most about SAMPLE rows; pivots of one source only if it is named."""
    counts = {r["source"]: r["n"] for r in points.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = max(1, math.ceil(total / min(SAMPLE, max(LEAST_SAMPLE, SAMPLE_EACH * total // cell_points))))
    sample = points.filter(F.pmod(F.xxhash64("source", "id"), F.lit(share)) == 0).select("source", "id", "lon", "lat").toPandas().sort_values(["source", "id"])
    lon, lat = np.radians(sample["lon"].to_numpy(float)), np.radians(sample["lat"].to_numpy(float))
    own = sample["source"].to_numpy() == pivots_from if pivots_from is not None else np.ones(len(lon), bool)
    places = np.unique(np.stack([lon[own], lat[own]], axis=1), axis=0) if own.any() else np.zeros((1, 2))
    k = int(min(MAX_PIVOTS, len(places), max(1, math.ceil(total / cell_points))))
    pick = np.random.default_rng(7).permutation(len(places))[:k]
    layout = Layout(places[pick, 0], places[pick, 1], np.ones(k, np.int64), np.ones(k, np.int64))
    if len(lon):
        home = layout.tree.nearest(lon, lat)[0]
        kinds = sample["source"].to_numpy()
        for kept, name in ((targets, "rows"), (queries, "columns")):
            size = np.bincount(home[np.isin(kinds, list(kept))], minlength=k) * share
            setattr(layout, name, np.maximum(1, size // (4 * cell_points)).astype(np.int64))
        layout.__post_init__()
    return layout


def voronoi_join(
    spark: SparkSession,
    points: dict[str, tuple[DataFrame, str]],
    near: list[Near],
    regions: dict[str, tuple[DataFrame, str]] | None = None,
    within: list[Within] | None = None,
    cell_points: int = CELL_POINTS,
) -> DataFrame:
    """(rel, point_id, other_id) of all ``near`` and ``within`` relations.

    ``points`` maps a name to (table with lon and lat, its id column); ``regions`` to (table with rings, its id column).
    """
    regions, within = regions or {}, within or []
    names = [*points, *regions]
    number = {name: i for i, name in enumerate(names)}
    radius = {number[name]: max((r.metres for r in near if r.query == name), default=-1.0) for name in points}
    targets = {number[r.target] for r in near} | {number[r.point] for r in within}
    everything = None
    for name, (frame, id_column) in points.items():
        part = usable(frame, id_column, number[name])
        everything = part if everything is None else everything.unionByName(part)
    layout = plan_layout(everything, {s for s, r in radius.items() if r >= 0}, targets, cell_points)
    shared = spark.sparkContext.broadcast((layout.lon, layout.lat, layout.rows, layout.columns))

    def route_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Layout(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                source, ids, lon, lat = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                x, y = np.radians(lon), np.radians(lat)
                home, own = grid.tree.nearest(x, y)
                spot = spots(ids)
                stay = np.flatnonzero(np.isin(source, list(targets)))
                who, cells = grid.target_blocks(home[stay], spot[stay])
                who = stay[who]
                yield _routed(cells, TARGET, source[who], ids[who], lon[who], lat[who])
                for kind, metres in radius.items():
                    asks = np.flatnonzero(source == kind) if metres >= 0 else ()
                    if not len(asks):
                        continue
                    q, cell = grid.cells_within(x[asks], y[asks], own[asks] + 2 * metres + SLACK_M)
                    who, cells = grid.query_blocks(cell, spot[asks[q]])
                    who = asks[q[who]]
                    yield _routed(cells, QUERY, source[who], ids[who], lon[who], lat[who])

    routed = everything.mapInArrow(route_points, ROUTED)

    def route_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Layout(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                outline = _ring(batch.column(2)[i].as_py())
                if outline is None:
                    continue
                lon, lat, metres = _ball(outline[0])
                x, y = np.radians([lon]), np.radians([lat])
                for cell in grid.cells_within(x, y, grid.tree.nearest(x, y)[1] + 2 * metres + SLACK_M)[1]:
                    # Outlines meet each target once: in the first column of every row.
                    blocks = grid.base[cell] + np.arange(grid.rows[cell]) * grid.columns[cell]
                    n = len(blocks)
                    rings = pa.array([batch.column(2)[i].as_py()] * n, batch.schema.field(2).type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(blocks), pa.array(np.full(n, REGION, np.int32)), batch.column(0).take(pa.array([i] * n)), batch.column(1).take(pa.array([i] * n)), pa.array(np.full(n, lon)), pa.array(np.full(n, lat)), rings],
                        names=_NAMES,
                    )

    for name, (frame, id_column) in regions.items():
        wanted = frame.select(F.lit(number[name]).alias("source"), frame[id_column].cast("long").alias("id"), frame["rings"].alias("rings")).filter("rings is not null")
        routed = routed.unionByName(wanted.mapInArrow(route_regions, ROUTED))

    nears = [(r.name, number[r.query], number[r.target], float(r.metres)) for r in near]
    withins = [(r.name, number[r.point], number[r.region]) for r in within]

    def join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            yield from join_cell(cell, nears, withins, Layout(*shared.value))

    together = routed.repartition(4 * slots(spark), "cell").sortWithinPartitions("cell")
    return together.mapInArrow(join_cells, "rel string, point_id long, other_id long")


_NAMES = ["cell", "role", "source", "id", "lon", "lat", "rings"]


def _routed(cells: np.ndarray, role: int, source: np.ndarray, ids: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> pa.RecordBatch:
    rings = pa.nulls(len(cells), pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.full(len(cells), role, np.int32)), pa.array(source.astype(np.int32)), pa.array(ids, pa.int64()), pa.array(lon), pa.array(lat), rings], names=_NAMES)


def _ring(rings: list | None) -> list[np.ndarray] | None:
    """Rings as arrays; None if the outline has no area to be in."""
    found = [np.array([(p["lon"], p["lat"]) for p in ring if p and p["lon"] is not None and p["lat"] is not None], float) for ring in rings or [] if ring]
    return [r for i, r in enumerate(found) if i == 0 or len(r) >= 3] if found and len(found[0]) >= 3 else None


def _ball(outline: np.ndarray) -> tuple[float, float, float]:
    """Centre (degrees) and radius (metres) of a ball that holds the outline's box, sides sampled and 2 % added."""
    (west, south), (east, north) = outline.min(axis=0), outline.max(axis=0)
    lon, lat = (west + east) / 2, (south + north) / 2
    t = np.linspace(0, 1, 33)
    x = np.concatenate([west + t * (east - west)] * 2 + [np.full(33, west), np.full(33, east)])
    y = np.concatenate([np.full(33, south), np.full(33, north)] + [south + t * (north - south)] * 2)
    away = great_circle(np.radians(lon), np.radians(lat), np.radians(x), np.radians(y)).max()
    return lon, lat, min(away * 1.02 + 1, math.pi * EARTH_M)


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop == start:
                continue
            if held and held[0].column(0)[0].as_py() != cells[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def join_cell(cell: pa.Table, nears: list[tuple], withins: list[tuple], grid: Layout) -> Iterator[pa.RecordBatch]:
    """All pairs of one block of a cell."""
    role, source, ids, lon, lat = (cell.column(i).to_numpy() for i in range(1, 6))
    x, y = np.radians(lon), np.radians(lat)
    trees: dict[int, tuple[np.ndarray, VantageTree]] = {}
    for name, query, target, metres in nears:
        asks = np.flatnonzero((role == QUERY) & (source == query))
        if not len(asks):
            continue
        if target not in trees:
            at = np.flatnonzero((role == TARGET) & (source == target))
            trees[target] = at, VantageTree(x[at], y[at])
        at, tree = trees[target]
        for q, p in tree.within(x[asks], y[asks], metres):
            one, other = ids[asks[q]], ids[at[p]]
            if query == target:
                ordered = one < other
                one, other = one[ordered], other[ordered]
            if len(one):
                yield _pairs(name, one, other)
    block = cell.column(0)[0].as_py()
    c = int(np.searchsorted(grid.base, block, side="right")) - 1
    if not withins or (block - grid.base[c]) % grid.columns[c]:
        return
    for i in np.flatnonzero(role == REGION):
        outline = _ring(cell.column(6)[int(i)].as_py())
        (west, south), (east, north) = outline[0].min(axis=0), outline[0].max(axis=0)
        boxed = np.flatnonzero((role == TARGET) & (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north))
        inside = boxed[inside_rings(lon[boxed], lat[boxed], outline)]
        for name, point, region in withins:
            if source[i] == region:
                found = ids[inside[source[inside] == point]]
                if len(found):
                    yield _pairs(name, found, np.full(len(found), ids[i]))


def _pairs(name: str, one: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(one)), pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["rel", "point_id", "other_id"])


def joined_places(spark: SparkSession, points: dict[str, tuple[DataFrame, str]], near: list[Near], cell_points: int = CELL_POINTS) -> DataFrame:
    """(rel, place_id, other_id, points, others): ``near`` between places instead of points, a place being all points of a set with equal coordinates.

    A place is named by its least id and has its number of points, so copies of one place give one row and not their square; within one set a place of
    several points is also met with itself. The pairs of points are the products.
    """
    places, sizes = {}, None
    for name, (frame, id_column) in points.items():
        held = usable(frame, id_column, 0).groupBy("lon", "lat").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        places[name] = (held, "id")
        size = held.select(F.lit(name).alias("set"), "id", "n")
        sizes = size if sizes is None else sizes.unionByName(size)
    sets = spark.createDataFrame([(r.name, r.query, r.target) for r in near], "rel string, query string, target string")
    pairs = voronoi_join(spark, places, near, cell_points=cell_points).withColumnRenamed("point_id", "place_id")
    for r in near:
        if r.query == r.target:
            same = places[r.query][0].filter("n > 1").select(F.lit(r.name).alias("rel"), F.col("id").alias("place_id"), F.col("id").alias("other_id"))
            pairs = pairs.unionByName(same)
    told = pairs.join(F.broadcast(sets), "rel")
    one = sizes.select(F.col("set").alias("query"), F.col("id").alias("place_id"), F.col("n").alias("points"))
    other = sizes.select(F.col("set").alias("target"), F.col("id").alias("other_id"), F.col("n").alias("others"))
    return told.join(one, ["query", "place_id"]).join(other, ["target", "other_id"]).select("rel", "place_id", "other_id", "points", "others")
