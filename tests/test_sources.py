import json
import struct

import numpy as np

from quadrant.operators import network_clean as net
from quadrant.sources import drawings, geojson, pages


def test_features(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"name": "a", "n": 2}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "y.json").write_text("not json")
    rows = geojson.read_features(spark, str(tmp_path), "name string, n int").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"], r["n"], r["lon"], r["lat"]) for r in rows] == [(0, "a", 2, 1.5, 2.5), (1, None, None, None, None)]
    out = [json.loads(r["value"]) for r in geojson.point_features(spark.createDataFrame([("a", 1.0, 2.0), (None, None, None)], "name string, lon double, lat double"), ["name"]).collect()]
    assert out[0] == {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}
    assert "geometry" not in out[1]


def test_drawing(spark, tmp_path):
    svg = """<svg xmlns="http://www.w3.org/2000/svg"><defs><rect width="9" height="9"/></defs>
    <g id="walls" fill="red" transform="translate(10,0) scale(2)"><rect x="1" y="1" width="2" height="3"/><path d="M0 0h2v2z m5 5 l1 1"/></g>
    <circle cx="0" cy="0" r="1"/><path d="M0,0 C0,1 1,1 1,0"/><polygon points="0,0 1,0 1,1"/></svg>"""
    (tmp_path / "a.svg").write_text(svg)
    (tmp_path / "b.svg").write_text("<svg><broken")
    rows = drawings.read_drawings(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["element"], r["layer"], r["closed"], len(r["points"])) for r in rows] == [("rect", "walls", True, 4), ("path", "walls", True, 3), ("path", "walls", False, 2), ("circle", None, True, 24), ("path", None, False, 13), ("polygon", None, True, 3)]
    assert [tuple(p) for p in rows[0]["points"]] == [(12, 2), (16, 2), (16, 8), (12, 8)]
    assert tuple(rows[4]["points"][-1]) == (1, 0)


def test_transforms_compose():
    m = drawings.transform_matrix("rotate(90) translate(1,0)")
    assert np.allclose(m @ [0, 0, 1], [0, 1, 1])
    assert np.allclose(drawings.transform_matrix("rotate(90, 1, 1)") @ [2, 1, 1], [1, 2, 1])


def test_mesh(spark, tmp_path):
    xyz = np.array([[0, 1, 2], [3, 4, 5]], "<f4").tobytes()
    doc = json.dumps({"meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 2}], "bufferViews": [{"byteLength": 24}]}).encode()
    doc += b" " * (-len(doc) % 4)
    data = b"glTF" + struct.pack("<II", 2, 12 + 8 + len(doc) + 8 + len(xyz)) + struct.pack("<I4s", len(doc), b"JSON") + doc + struct.pack("<I4s", len(xyz), b"BIN\0") + xyz
    (tmp_path / "m.glb").write_bytes(data)
    (tmp_path / "n.glb").write_bytes(b"glTF")
    rows = drawings.read_meshes(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(0, 1, 2), (3, 4, 5)]


def test_pages(spark):
    html = "<html><div class=card><!-- <li>no</li> --><li><b>Course:</b> A 1</li><li>Building: X, Y<br>Z</li></div><div><li>plain</li></div></html>"
    rows = pages.items(spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string"), "id", "html").collect()
    assert [(r["id"], r["item"], r["label"], r["value"]) for r in rows] == [(1, 1, "Course", "A 1"), (1, 2, "Building", "X, Y<br>Z"), (1, 1, None, "plain")]


def test_network(spark):
    lines = [("s", 1, 0.0, 0.0, 100.0, 0.0), ("s", 2, 50.0, -40.0, 50.0, 40.0), ("s", 3, 100.5, 0.5, 150.0, 0.0), ("s", 4, 20.0, 30.0, 20.0, 2.0), ("s", 5, 7.0, 7.0, 7.0, 7.0), ("s", 6, None, 0.0, 1.0, 1.0), ("t", 1, 0.0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(lines, "site string, id long, x1 double, y1 double, x2 double, y2 double")
    pieces = net.cut_at_crossings(frame, 30.0)
    assert pieces.filter("site = 's'").count() == 6
    rows = net.build_network(pieces).filter("site = 's'").collect()
    ends = {(round(r["x1"]), round(r["y1"])) for r in rows} | {(round(r["x2"]), round(r["y2"])) for r in rows}
    assert (20, 0) in ends and (50, 0) in ends and len(rows) == 8
    assert net.cut_at_crossings(frame.limit(0)).count() == 0


def test_splice_and_spacing(spark):
    import pandas as pd

    site = net.weld(pd.DataFrame({"x1": [0.0], "y1": [0.0], "x2": [100.0], "y2": [0.0]}), 2.0)
    nodes = net.splice(site, [(50.0, 10.0), (99.0, 5.0), (50.0, 500.0)], 150.0)
    assert nodes[2] is None and len(site.edges) == 4
    frame = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 5.0, 0.0), ("g", 3, 11.0, 0.0), ("h", 1, 0.0, 0.0), ("g", 4, None, 0.0)], "g string, o long, x double, y double")
    assert sorted(map(tuple, net.greedy_spacing(frame, "g", "o", "x", "y", 10.0).collect())) == [("g", 1), ("g", 3), ("h", 1)]
