import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quadrant.operators.packed_fields import split_cell, three_part, unpacked

SCHEMA = "card_id long, building string, id string, values string"


def test_forms():
    assert split_cell("Main, Hall, 1<br>Main, Shed, 2") == [["Main", "Hall", "1"], ["Main", "Shed", "2"]]
    assert split_cell('Main, "Hall, upper; east", 1') == [["Main", "Hall, upper; east", "1"]]
    assert split_cell('"Main, Hall, 1" | "Main, Shed, 2"') == [["Main", "Hall", "1"], ["Main", "Shed", "2"]]
    assert split_cell("Main|Hall|1\nMain|Shed|2") == [["Main", "Hall", "1"], ["Main", "Shed", "2"]]
    assert split_cell("Main; Hall; 1<BR />Main; Shed; 2") == [["Main", "Hall", "1"], ["Main", "Shed", "2"]]
    assert split_cell("Main;Main, Hall, 1") == [["Main"], ["Main", "Hall", "1"]]
    assert split_cell('Main, Hall ""x, 1')[0][0] == "Main"
    assert split_cell('Main, "Hall ""blue"" door", 1') == [["Main", 'Hall "blue" door', "1"]]
    assert split_cell("Main, Fish &amp;&nbsp;Chips, 1") == [["Main", "Fish & Chips", "1"]]
    assert split_cell(None) == split_cell("") == split_cell(" \n ") == []


def test_markers_in_the_text_survive():
    text = "Main, " + "0 amp 1, \"a, b\""
    assert split_cell(text) == [["Main", "" + "0 amp 1", "a, b"]]


def test_rows(spark):
    rows = [(1, 'Main, Hall, A, 1 <br> Main <br> Main, Shed, 2', "x", "y"), (2, None, "x", "y"), (3, "", None, None), (1, "Main,,3", "x", "y"), (4, "Main, Hall, " + "9" * 100_000, "x", "y")]
    found = three_part(spark.createDataFrame(rows, SCHEMA), "card_id", "building", ("campus", "building", "room"))
    got = {(r[0], r[1], r[2], r[3], r[4][:3]) for r in found.collect()}
    assert got == {(1, 1, "Main", "Hall, A", "1"), (1, 3, "Main", "Shed", "2"), (4, 1, "Main", "Hall", "999")}
    values = unpacked(spark.createDataFrame(rows[:1], SCHEMA), "card_id", "building").collect()
    assert [(r["pos"], r["at"], r["value"]) for r in values][:4] == [(1, 1, "Main"), (1, 2, "Hall"), (1, 3, "A"), (1, 4, "1")]
    assert three_part(spark.createDataFrame([], SCHEMA), "card_id", "building", ("a", "b", "c")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_characters='"&<\r\n'), min_size=1, max_size=12), min_size=3, max_size=3), min_size=1, max_size=4))
def test_quoted_round_trip(listings):
    clean = [[" ".join(v.split()) or "x" for v in row] for row in listings]
    cell = "<br>".join(", ".join(f'"{v}"' for v in row) for row in clean)
    assert split_cell(cell) == [[" ".join(re.sub(r"&(\w+);", r"\1", v).split()) for v in row] for row in clean]
