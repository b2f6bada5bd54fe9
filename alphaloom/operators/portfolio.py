"""Portfolio construction for many scenarios at once: rebalance calendars, Top-N and hold-until-drop selection, equal weights.

A scenario is a row (scenario, top_n, rebalance_frequency, buffer_enabled, drop_rank_buffer) of a small
table, so a sensitivity grid is one plan and not a loop. Ranks are made once per date for all scenarios.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions.scalars import rounded
from alphaloom.operators.factors import HISTORICAL
from alphaloom.operators.panel import date_index
from alphaloom.operators.ranks import dealt, must_spread, spread_ranks
from alphaloom.operators.scoreboard import selected_factor_scores

FREQUENCIES = ["daily", "weekly", "monthly"]


def scenarios(spark: SparkSession, rows: list[tuple[str, int, str, bool, int]]) -> DataFrame:
    """scenario, top_n, rebalance_frequency, buffer_enabled, drop_rank_buffer."""
    return spark.createDataFrame(rows, "scenario string, top_n int, rebalance_frequency string, buffer_enabled boolean, drop_rank_buffer int")


def rebalance_calendar(bars: DataFrame, frequency: str = "daily", lag: int = 1) -> DataFrame:
    """Signal dates and the trading day ``lag`` after each; dates without one are dropped."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"Unknown rebalance frequency: {frequency!r}")
    return calendars(bars, lag, [frequency])


def calendars(bars: DataFrame, lag: int = 1, frequencies: list[str] = FREQUENCIES) -> DataFrame:
    """The calendars of all frequencies, from one pass over the dates: a date is the first of its week or month if the date before is of another."""
    if lag < 1:
        raise ValueError("execution lag must be one day at least")
    order = Window.orderBy("date_idx")
    before = F.lag("date").over(order)

    def first(unit: str) -> Column:
        return F.coalesce(F.date_trunc(unit, before) != F.date_trunc(unit, "date"), F.lit(True))

    signals = {"daily": F.lit(True), "weekly": first("week"), "monthly": first("month")}
    days = date_index(bars).select(F.col("date").alias("signal_date"), F.lead("date", lag).over(order).alias("execution_date"), F.array_compact(F.array(*(F.when(signals[f], f) for f in frequencies))).alias("_on"))
    return days.where("execution_date is not null").select("signal_date", "execution_date", F.explode("_on").alias("rebalance_frequency"), F.lit(lag).alias("execution_lag_days"))


def ranked_scores(composite: DataFrame, factor: str = HISTORICAL, spread: bool | None = None) -> DataFrame:
    """date, ticker, factor_score, rank: best first, ties by ticker, null scores dropped. ``spread``: see ``with_pct_ranks``."""
    scored = selected_factor_scores(composite, factor).where("composite_score is not null")
    if must_spread(scored, ["date"]) if spread is None else spread:
        own = scored.select("date", "ticker", F.col("composite_score").alias("factor_score"), rounded(F.col("composite_score"), 10).alias("_v"))
        return spread_ranks(own, ["date"], "_v", descending=True, ties=["ticker"]).select("date", "ticker", "factor_score", F.col("_position").cast("int").alias("rank"))
    order = Window.partitionBy("date").orderBy(rounded(F.col("composite_score"), 10).desc(), "ticker")
    return dealt(scored, ["date"]).select("date", "ticker", F.col("composite_score").alias("factor_score"), F.row_number().over(order).alias("rank"))


def on_schedule(positions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Only the signal dates of each row's frequency."""
    days = calendar.select(F.col("signal_date").alias("date"), "rebalance_frequency")
    return positions.join(days, ["date", "rebalance_frequency"], "left_semi")


def topn_buffered(candidates: DataFrame) -> DataFrame:
    """Hold-until-drop: scenario, date, ticker of what is held.

    From each date to the next a holding stays while its rank is within drop_rank_buffer; then the
    best ranks fill up to top_n. Only ranks up to the larger of the two can ever be held, so a date is a short array
    and the state is top_n names at most. Dates stream through in order, batch by batch, and the state goes
    from one batch to the next: nothing holds all dates of a scenario. Scenarios run in parallel.
    """
    near = candidates.where(F.col("rank") <= F.greatest("top_n", "drop_rank_buffer"))
    days = near.groupBy("scenario", "top_n", "drop_rank_buffer", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("ranked"))

    # a function of its own names only, so that executors need nothing but it
    def fold(batches):
        run, held = None, []
        for batch in batches:
            names, dates, chosen = [], [], []
            rows = batch.to_pydict()
            for name, top, reach, date, ranked in zip(rows["scenario"], rows["top_n"], rows["drop_rank_buffer"], rows["date"], rows["ranked"]):
                if name != run:
                    run, held = name, []
                kept = set(held)
                stay = [t for t in ranked[:reach] if t in kept]
                kept = set(stay)
                held = (stay + [t for t in ranked[:top] if t not in kept])[:top]
                names += [name] * len(held)
                dates += [date] * len(held)
                chosen += held
            yield pa.RecordBatch.from_pydict({"scenario": names, "date": dates, "ticker": chosen}, schema=pa.schema([("scenario", pa.string()), ("date", pa.date32()), ("ticker", pa.string())]))

    return days.repartition("scenario").sortWithinPartitions("scenario", "date").mapInArrow(fold, "scenario string, date date, ticker string")


def topn_positions(composite: DataFrame, grid: DataFrame, calendar: DataFrame | None = None, factor: str = HISTORICAL, near_only: bool = False) -> DataFrame:
    """Ranked rows of every scenario with column selected; on the signal dates of the scenario's frequency if a calendar is given.

    ``near_only`` leaves out the ranks that no rule can select, before scenarios multiply the rows: all that weights need.
    """
    rows = ranked_scores(composite, factor)
    reach = F.greatest("top_n", F.when(F.col("buffer_enabled"), F.col("drop_rank_buffer")).otherwise(F.lit(0)))
    near = F.col("rank") <= reach
    rows = rows.join(F.broadcast(grid), near) if near_only else rows.join(F.broadcast(grid))  # a row per scenario
    if calendar is not None:
        rows = on_schedule(rows, calendar)
    selected = F.col("rank") <= F.col("top_n")
    if not grid.where("buffer_enabled").isEmpty():
        held = topn_buffered(rows.where("buffer_enabled")).withColumn("_held", F.lit(True))
        rows = rows.join(held, ["scenario", "date", "ticker"], "left")
        selected = F.when(F.col("buffer_enabled"), F.coalesce("_held", F.lit(False))).otherwise(selected)
    rule = F.when(F.col("buffer_enabled"), "buffer").otherwise("top_n")
    return rows.select("scenario", "date", "ticker", "factor_score", "rank", selected.alias("selected"), "top_n", rule.alias("selection_rule"), "rebalance_frequency", "buffer_enabled", "drop_rank_buffer")


def equal_weights(positions: DataFrame, lag: int = 1, execution: str = "calendar_day", bars: DataFrame | None = None) -> DataFrame:
    """One over the number selected, per scenario and date; executed ``lag`` calendar days later, or trading days of ``bars``."""
    chosen = positions.where("selected")
    count = F.count("ticker").over(Window.partitionBy("scenario", "date"))
    rows = chosen.select("scenario", "date", "ticker", (1.0 / count).alias("target_weight"), F.lit(lag).alias("execution_lag_days"))
    if execution == "calendar_day":
        return rows.withColumn("execution_date", F.date_add("date", lag))
    if execution != "trading_day" or bars is None:
        raise ValueError("execution is calendar_day, or trading_day with bars")
    days = rebalance_calendar(bars, "daily", lag).select(F.col("signal_date").alias("date"), "execution_date")
    return rows.join(days, "date")
