from stemma.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 7, "a", 1.0), (2, "2024-01-01 00:50:00", 7, "a", 2.0), (3, "2024-01-01 02:00:00", 7, "b", 3.0), (4, "2024-01-01 00:30:00", 8, "a", 4.0)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = windows.by_window(events, "1 hour")
    stream = windows.by_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.format("memory").queryName("by_hour").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("by_hour").collect()} == {tuple(r) for r in batch.collect()}
    runs = windows.sessions(events, "30 minutes")
    assert sorted((r["user_id"], r["n"]) for r in runs.collect()) == [(7, 1), (7, 1), (7, 1), (8, 1)]
    assert sorted(r["n"] for r in windows.sessions(events, "45 minutes").collect()) == [1, 1, 2]


def test_answers_are_appended_once(spark, tmp_path):
    from stemma.sources.tables import ANSWER

    path = str(tmp_path / "answers")
    spark.createDataFrame([], f"cache_key string, answer {ANSWER}").write.parquet(path)
    spark.createDataFrame([("x",), ("x",), ("y",)], "cache_key string").coalesce(1).write.parquet(str(tmp_path / "keys"))
    for _ in range(2):
        keys = spark.readStream.schema("cache_key string").parquet(str(tmp_path / "keys"))
        windows.append_answers(keys, path, str(tmp_path / "ck"), lambda key: '{"matchType": "EXACT"}').awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(path).select("cache_key").collect()) == ["x", "y"]
