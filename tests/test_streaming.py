"""Bars from a stream equal bars from the same trades at rest, less the day still open."""

import datetime as dt

from alphaloom.streaming.bars import stream_bars


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 9)
    rows = [(t0 + dt.timedelta(hours=7 * k), "AB"[k % 2], 10.0 + k % 5, 1.0 + k) for k in range(40)]
    trades = spark.createDataFrame(rows, "ts timestamp, ticker string, price double, size double")
    trades.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in"))
    query = stream_bars(stream).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["date"], r["ticker"]): tuple(r) for r in spark.table("bars").collect()}
    want = {(r["date"], r["ticker"]): tuple(r) for r in stream_bars(trades).collect()}
    last = max(d for d, _ in want)
    assert got and all(want[k] == v for k, v in got.items())
    assert {k for k in want if (last - k[0]).days > 2} <= set(got)
