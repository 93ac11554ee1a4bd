import duckdb
import pytest

from quadrant.plans import ranking


@pytest.mark.parametrize(("query", "frame", "least"), [("part_rank_top8", "part", 40), ("doc_rank_top8", "documents", 40)])
def test_ranking_over_rows_and_texts_equals_its_sql(spark, small, query, frame, least):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW {frame} AS SELECT * FROM '{small}/{frame}.parquet'")
    expected = sorted(database.execute(ranking.ORACLES[query]).fetchall())
    got = sorted(tuple(r) for r in ranking.QUERIES[query](spark, small).select("query", "ordinal", "score", "place").collect())
    assert got == expected and len(got) >= least
