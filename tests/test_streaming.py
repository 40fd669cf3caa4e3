import datetime as dt

from hypomill.streaming.live import windowed_error_rate


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2031, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "s", r, h) for m, r, h in ((1, "a b", "a x"), (30, "c", "c"), (61, "d", "e"), (200, "f", "f"))]
    schema = "at timestamp, system string, r string, h string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windowed_error_rate(stream, "at", "r", "h", "system").writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.window_start, r.errors, r.error_rate) for r in spark.table("live").collect())
    want = sorted((r.window_start, r.errors, r.error_rate) for r in windowed_error_rate(spark.createDataFrame(rows, schema), "at", "r", "h", "system").collect())
    assert got == want == [(t, 1, 1 / 3), (t + dt.timedelta(hours=1), 1, 1.0), (t + dt.timedelta(hours=3), 0, 0.0)]
