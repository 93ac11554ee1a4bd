"""Vector drawings (SVG) and binary meshes (GLB) as rows.

Files are read whole, one per row, and parsed on Arrow batches in Python, as both formats need a stack or a byte cursor.

Defined results: a file that cannot be parsed gives no rows; definitions and clip paths are not drawn; unknown elements are passed over;
an arc is drawn as its chord; shapes with fewer than two points give no ring.
"""

from __future__ import annotations

import json
import math
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(r"[MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
CALL = re.compile(r"(\w+)\s*\(([^)]*)\)")
#: Numbers that each path command takes, and points that each curve is drawn with.
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7}
CUBIC_POINTS, QUADRATIC_POINTS, CIRCLE_POINTS = 12, 8, 24
IDENTITY = np.eye(3)
HIDDEN = {"defs", "clipPath", "mask", "symbol", "pattern", "marker"}


def transform_matrix(text: str | None) -> np.ndarray:
    """The 3 x 3 matrix of a transform attribute; unknown calls change nothing."""
    result = IDENTITY
    for name, inside in CALL.findall(text or ""):
        v = [float(x) for x in NUMBER.findall(inside)]
        m = np.eye(3)
        if name == "translate" and v:
            m[0, 2], m[1, 2] = v[0], v[1] if len(v) > 1 else 0.0
        elif name == "scale" and v:
            m[0, 0], m[1, 1] = v[0], v[1] if len(v) > 1 else v[0]
        elif name == "rotate" and v:
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            m[:2, :2] = [[c, -s], [s, c]]
            if len(v) == 3:
                x, y = v[1:]
                m[0, 2], m[1, 2] = x - c * x + s * y, y - s * x - c * y
        elif name == "matrix" and len(v) == 6:
            m[:2] = [[v[0], v[2], v[4]], [v[1], v[3], v[5]]]
        result = result @ m
    return result


def path_rings(d: str) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points, closed) of each subpath of a path."""
    tokens = TOKEN.findall(d or "")
    rings: list[tuple[list[tuple[float, float]], bool]] = []
    points: list[tuple[float, float]] = []
    here = start = (0.0, 0.0)
    handle: tuple[float, float] | None = None
    command, at = "", 0

    def finish(closed: bool) -> None:
        nonlocal points
        if len(points) > 1:
            rings.append((points, closed))
        points = []

    while at < len(tokens):
        if tokens[at].isalpha():
            command, at = tokens[at], at + 1
            if command in "Zz":
                finish(True)
                here, handle = start, None
                continue
        kind = command.upper()
        need = ARGUMENTS.get(kind)
        if need is None or at + need > len(tokens):
            break
        try:
            v = [float(t) for t in tokens[at : at + need]]
        except ValueError:
            break
        at += need
        ox, oy = here if command.islower() else (0.0, 0.0)
        if kind == "M":
            finish(False)
            here = start = (v[0] + ox, v[1] + oy)
            points, handle = [here], None
            command = "l" if command == "m" else "L"
            continue
        if not points:
            points = [here]
        if kind == "H":
            end, line = (v[0] + ox, here[1]), []
        elif kind == "V":
            end, line = (here[0], v[0] + oy), []
        else:
            end = (v[-2] + ox, v[-1] + oy)
            line = []
        before, handle_now = handle, None
        if kind in "CS":
            mirrored = (2 * here[0] - before[0], 2 * here[1] - before[1]) if before else here
            c1 = (v[0] + ox, v[1] + oy) if kind == "C" else mirrored
            c2 = (v[-4] + ox, v[-3] + oy)
            line = _curve([here, c1, c2, end], CUBIC_POINTS)
            handle_now = c2
        elif kind in "QT":
            c1 = (v[0] + ox, v[1] + oy) if kind == "Q" else (2 * here[0] - before[0], 2 * here[1] - before[1]) if before else here
            line = _curve([here, c1, end], QUADRATIC_POINTS)
            handle_now = c1
        points += line or [end]
        here, handle = end, handle_now
    finish(False)
    return rings


def _curve(control: list[tuple[float, float]], n: int) -> list[tuple[float, float]]:
    """Points 1 to n of a Bezier curve, by repeated interpolation."""
    t = np.linspace(0, 1, n + 1)[1:, None]
    level = [np.repeat(np.array([c], float), n, axis=0) for c in control]
    while len(level) > 1:
        level = [a + (b - a) * t for a, b in zip(level, level[1:], strict=False)]
    return [tuple(map(float, p)) for p in level[0]]


def drawn_shapes(text: str) -> Iterator[tuple[str, str | None, str | None, str | None, list[tuple[float, float]], bool]]:
    """(element, fill, stroke, layer, points, closed) of everything drawn, nested transforms applied."""
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return
    waiting = [(root, IDENTITY, None, None, None)]
    while waiting:
        node, matrix, fill, stroke, layer = waiting.pop()
        name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if name in HIDDEN or not name:
            continue
        matrix = matrix @ transform_matrix(node.get("transform"))
        fill, stroke = node.get("fill", fill), node.get("stroke", stroke)
        if name == "g" and node.get("id"):
            layer = node.get("id")
        number = lambda key, n=node: float((NUMBER.findall(n.get(key) or "") or ["0"])[0])
        rings: list[tuple[list[tuple[float, float]], bool]] = []
        if name == "path":
            rings = path_rings(node.get("d", ""))
        elif name == "rect":
            x, y, w, h = map(number, ("x", "y", "width", "height"))
            rings = [([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], True)]
        elif name in ("polygon", "polyline"):
            v = [float(t) for t in NUMBER.findall(node.get("points", ""))]
            rings = [(list(zip(v[::2], v[1::2], strict=False)), name == "polygon")]
        elif name == "line":
            rings = [([(number("x1"), number("y1")), (number("x2"), number("y2"))], False)]
        elif name in ("circle", "ellipse"):
            rx, ry = (number("r"),) * 2 if name == "circle" else (number("rx"), number("ry"))
            turn = np.linspace(0, 2 * math.pi, CIRCLE_POINTS, endpoint=False)
            rings = [([(number("cx") + rx * math.cos(a), number("cy") + ry * math.sin(a)) for a in turn], True)]
        for points, closed in rings:
            if len(points) > 1:
                moved = (matrix @ np.column_stack([np.array(points, float), np.ones(len(points))]).T)[:2].T
                yield name, fill, stroke, layer, [tuple(map(float, p)) for p in moved], closed
        waiting += [(child, matrix, fill, stroke, layer) for child in reversed(list(node))]


SHAPES = "file string, ordinal int, element string, fill string, stroke string, layer string, closed boolean, points array<struct<x:double,y:double>>"


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """Every drawn shape of the SVG files at a path."""
    return parse_drawings(spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "value"))


def parse_drawings(files: DataFrame) -> DataFrame:
    """Every drawn shape of SVG texts (file, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(file, i, *shape) for i, shape in enumerate(drawn_shapes(text or ""))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    points = pa.array([[{"x": x, "y": y} for x, y in p] for p in columns[6]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                    arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:6]), pa.array(columns[7], pa.bool_()), points]
                    yield pa.RecordBatch.from_arrays(arrays, names=[p.split()[0] for p in SHAPES.split(", ")])

    return files.select("file", "value").mapInArrow(run, SHAPES)


def mesh_positions(data: bytes) -> Iterator[np.ndarray]:
    """N x 3 float arrays: the positions of every primitive of a binary glTF file that are not compressed."""
    if len(data) < 20 or data[:4] != b"glTF":
        return
    at, document, body = 12, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"JSON":
            document = json.loads(chunk)
        elif kind == b"BIN\0":
            body = chunk
        at += 8 + size
    for mesh in (document or {}).get("meshes", []):
        for primitive in mesh.get("primitives", []):
            index = primitive.get("attributes", {}).get("POSITION")
            if index is None:
                continue
            accessor = document["accessors"][index]
            if accessor.get("componentType") != 5126 or accessor.get("type") != "VEC3" or "bufferView" not in accessor:
                continue
            view = document["bufferViews"][accessor["bufferView"]]
            start = view.get("byteOffset", 0) + accessor.get("byteOffset", 0)
            step, n = view.get("byteStride", 12), accessor["count"]
            if start + step * (n - 1) + 12 <= len(body):
                yield np.ndarray((n, 3), "<f4", body, start, (step, 4)).astype(float)


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """(file, primitive, x, y, z) of every vertex of the GLB files at a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, xyz in enumerate(mesh_positions(data or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(xyz)), pa.array(np.full(len(xyz), i, np.int32)), *(pa.array(xyz[:, k]) for k in range(3))], names=["file", "primitive", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, primitive int, x double, y double, z double")
