from quadrant.streaming import live


def run(spark, tmp_path, name, build, rows, schema, mode):
    """Two micro-batches through a query into memory."""
    source = tmp_path / "in"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(source / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60), "the stream did not end"
    finally:
        query.stop()
    return spark.sql(f"select * from {name}").collect()


def test_rate_limit_keeps_its_state_between_batches(spark, tmp_path):
    rows = [[(1, 0, 0), (1, 10, 1)], [(1, 20, 2), (1, 1000, 3), (None, 5, 4)]]
    got = run(spark, tmp_path, "limited", lambda s: live.rate_limit(s, "user", "at", "id", 1000, 2, expire=False), rows, "user long, at long, id long", "append")
    assert {r["id"]: r["allowed"] for r in got} == {0: True, 1: True, 2: False, 3: True}


def test_decayed_visits(spark, tmp_path):
    rows = [[("a", 0), ("a", 1000)], [("a", 2000), ("b", 0)]]
    got = run(spark, tmp_path, "visits", lambda s: live.decayed_visits(s, "name", "at", 1000.0), rows, "name string, at long", "update")
    assert max(r["at"] for r in got if r["name"] == "a") == 2000
    assert [round(r["weight"], 6) for r in got if r["name"] == "a" and r["at"] == 2000] == [1.75]


def test_progress_never_goes_back(spark, tmp_path):
    rows = [[("w", 0, 10.0), ("w", 1, 120.0)], [("w", 2, 5.0), ("w", 3, 300.0)]]
    got = run(spark, tmp_path, "walk", lambda s: live.progress(s, "walk", "at", "along", [0.0, 100.0, 200.0], 25.0), rows, "walk string, at long, along double", "append")
    assert [r["step"] for r in sorted(got, key=lambda r: r["at"])] == [1, 2, 2, 2]
