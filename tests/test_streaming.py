from __future__ import annotations


from folioflow.streaming.marks import stream_marks


def test_state_lives_across_batches(spark, tmp_path):
    schema = "user_id long, ts long, seq int, action string, book string, chapter int, verse int"
    batches = [[(1, 1, 1, "add", "a", 1, None), (1, 2, 2, "read", "a", 1, None)], [(1, 4, 4, "remove", "a", 1, None), (1, 3, 3, "add", "b", 2, 7), (2, 1, 1, "toggle", "c", 1, None)]]
    source = tmp_path / "in"
    got = []
    source.mkdir()
    events = spark.readStream.schema(schema).parquet(str(source))
    run = stream_marks(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: got.append(sorted(map(tuple, df.collect())))).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            run.processAllAvailable()
    finally:
        run.stop()
    assert [g for g in got if g] == [[(1, 1, "a:1", "a")], [(1, 1, "b:2:7", "a"), (2, 1, "c:1", None)]]
