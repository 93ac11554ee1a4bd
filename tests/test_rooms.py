import pytest

from quadrant.operators.room_lookup import answers_in_order, look_up, match_registry, room_index

MEETING = "meeting_id long, course string, title string, campus string, building string, room string, extra string"
ROWS = [
    (1, "ACCT 101", "Accounting", "Home", "STEM", "320", "x"), (2, "ACCT 101", "Accounting II", "Home", "TEW", "401", None), (3, "BIO 2", "Biology", "Home", "Science", "401", None), (4, "BIO 2", "Biology", "Away", "Mather", "7", None), (5, "NUR 9", None, "Away", "Hospital", "320", None),
    (6, "MUS 101", "Music", "Home", "Fine Arts", "501", None), (7, "ART 1", "Art", "Home", "MUS", "101", None), (8, None, None, "Home", "stem", None, None), (9, "X", "x", "Home", " ", "1", None), (10, "ACCT 101", "Accounting", "Home", "STEM", "320", "x"),
]
REGISTRY = [("STEM Innovation Center", 1, 1.0, 2.0), ("Technical Education West", 2, 1.0, 2.0), ("TEW", 3, 1.5, 2.5), ("Science & Engineering", 4, 1.0, 2.0), ("Fine & Applied Arts", 5, 1.0, 2.0), ("Music", 6, 1.0, 2.0)]


@pytest.fixture(scope="module")
def index(spark):
    return room_index(spark.createDataFrame(ROWS, MEETING), spark.createDataFrame(REGISTRY, "name string, ordinal long, lon double, lat double"), "Home")


def ask(spark, index, *queries):
    rows = answers_in_order(look_up(spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string"), index)).orderBy("query_id", "position").collect()
    return [(r["query_id"], r["rank"], r["place"], r["name"], r["elsewhere"], r["point"] is not None) for r in rows]


def test_a_building_and_a_room(spark, index):
    assert ask(spark, index, "stem  320", "STEM Innovation Center 320") == [(0, 0, "STEM Innovation Center", "Room 320", False, True), (1, 0, "STEM Innovation Center", "Room 320", False, True)]


def test_a_bare_room_is_told_for_every_building(spark, index):
    rows = look_up(spark.createDataFrame([(1, "401")], "query_id long, query string"), index).collect()
    assert sorted((r["place"], r["description"]) for r in rows) == [("Science & Engineering", "Science & Engineering · one of 2"), ("TEW", "TEW · one of 2")]


def test_courses_and_other_campuses(spark, index):
    assert ask(spark, index, "bio 2") == [(0, 1, "Science & Engineering", "BIO 2 — Biology", False, True), (0, 1, "Mather", "BIO 2 — Biology", True, False)]
    assert ask(spark, index, "NUR 9") == [(0, 1, "Hospital", "NUR 9", True, False)]
    assert [r[2] for r in ask(spark, index, "acct 101")] == ["STEM Innovation Center", "TEW"]


def test_a_query_that_is_both_and_queries_that_are_neither(spark, index):
    assert [(r[1], r[2]) for r in ask(spark, index, "MUS 101")] == [(0, "Music"), (1, "Fine Arts")]
    assert ask(spark, index, "library", "", "   ", None, "9999", "STEM 9999", "Hospital 320", "Fine Arts") == []
    # Room numbers of other campuses make no room ambiguous.
    assert len(ask(spark, index, "320")) == 1


def test_the_cascade_of_names(spark):
    registry = spark.createDataFrame(REGISTRY, "name string, ordinal long, lon double, lat double")
    got = {r["name"]: (r["place"], r["how"]) for r in match_registry(spark.createDataFrame([(n,) for n in ("TEW", "science-engineering", "Science", "Fine", "Nowhere", "", None)], "name string"), registry).collect()}
    assert got == {"TEW": ("TEW", "name"), "science-engineering": ("Science & Engineering", "key"), "Science": ("Science & Engineering", "prefix"), "Fine": ("Fine & Applied Arts", "prefix"), "Nowhere": (None, None), "": (None, None)}


def test_an_empty_timetable_answers_nothing(spark):
    empty = room_index(spark.createDataFrame([], MEETING), spark.createDataFrame(REGISTRY, "name string, ordinal long, lon double, lat double"), "Home")
    assert ask(spark, empty, "STEM 320") == []
