"""Daily bars from a stream of trades, in the shape that the panel operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """date, ticker, open, high, low, close, volume from trades (ts, ticker, price, size).

    A day's bar is emitted once the watermark has passed its end; trades that are later than ``late``
    are not counted. State is one small row per open day and ticker. Works on batch frames, too.
    """
    day = F.window("ts", "1 day")
    bars = trades.where("ticker is not null and price is not null").withWatermark("ts", late).groupBy(day.alias("day"), "ticker").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    )
    return bars.select(F.to_date("day.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")
