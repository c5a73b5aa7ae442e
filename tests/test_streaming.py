import datetime as dt

from bitloom.streaming.events import sessions, stream_files, windowed


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), 1, "a", 1.0) for h in range(3) for m in (0, 30)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed(stream_files(spark, str(tmp_path / "in"), df.schema), "1 hour", late="10 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from w").collect())) == sorted(map(tuple, windowed(df, "1 hour").collect()))
    assert sessions(df, "45 minutes").first()["n"] == 6
