import random
import re

from quadrant.llm import format_duplicates as fd

SCHEMA = "meeting_id long, course string, section string, campus string, building string, room string, id string, record string"
EXACT, FREE = ["course", "section", "campus"], ["building", "room"]


def canon(row):
    strip = lambda t: re.sub(r"[^\w]|_", "", t or "").lower().upper()
    return (*[v or "" for v in row[1:4]], *sorted(map(strip, row[4:6])))


def brute(rows):
    first = {}
    for row in sorted(rows):
        first.setdefault(canon(row), row[0])
    return sorted((first[canon(r)], r[0]) for r in rows if first[canon(r)] != r[0])


def test_against_brute_force(spark):
    rng = random.Random(3)
    forms = ["Main Hall", "main-hall", " MAIN  HALL!", "MainHall", "Main Halls", None, "", " ", "Straße", "STRASSE", "12", "1 2", "Ünï"]
    rows = [(i, "C", rng.choice("ab"), rng.choice(["x", None, ""]), rng.choice(forms), rng.choice(forms), "z", None) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = fd.copies_of_first(frame, "meeting_id", EXACT, FREE)
    assert got.columns == ["first_id", "id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    records = fd.distinct_records(frame.drop("id", "record"), "meeting_id", EXACT, FREE).collect()
    assert sum(r["copies"] for r in records) == 600 and len(records) == 600 - len(brute(rows))
    check = fd.hash_collisions(frame, "meeting_id", EXACT, FREE).first()
    assert check["records"] == check["hashes"] == len(records) and check["collided"] == 0


def test_hot_group_takes_the_broadcast_way(spark):
    rows = [(i, "C", "s", "x", "Main Hall" if i % 3 else "MAIN hall", "1", None, None) for i in range(20_000)] + [(30_000 + i, "C", "s", "x", f"B{i}", "1", None, None) for i in range(50)]
    got = fd.copies_of_first(spark.createDataFrame(rows, SCHEMA), "meeting_id", EXACT, FREE)
    assert got.count() == 19_999 and got.select("first_id").distinct().count() == 1


def test_long_and_empty(spark):
    long = "x" * 200_000
    rows = [(1, "C", "s", "x", long, "1", None, None), (2, "C", "s", "x", "1", long.upper() + "!", None, None)]
    assert [tuple(r) for r in fd.copies_of_first(spark.createDataFrame(rows, SCHEMA), "meeting_id", EXACT, FREE).collect()] == [(1, 2)]
    none = spark.createDataFrame([], SCHEMA)
    assert fd.copies_of_first(none, "meeting_id", EXACT, FREE).count() == 0
    assert fd.hash_collisions(none, "meeting_id", EXACT, FREE).first()["records"] == 0
