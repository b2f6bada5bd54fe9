"""Data-quality and validation tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.operators.panel import with_date_idx

from alphaloom.functions.scalars import rounded

# Fixed texts.
LIMITED = "valuation inputs are latest snapshot data because the valuation date column is empty; they are not historical point-in-time factors."
DATED = "Valuation inputs include dated observations."


def missing_ratio_columns(df: DataFrame) -> DataFrame:
    """Share of nulls per column at four digits; no rows for an empty frame."""
    row = df.agg(*(rounded(F.avg(F.col(f"`{c}`").isNull().cast("double")), 4).alias(c) for c in df.columns))
    return row.unpivot([], df.columns, "column_name", "missing_ratio").where("missing_ratio is not null")


def missing_ratio_overall(df: DataFrame) -> DataFrame:
    """Mean of the columns' null shares; 0 for an empty frame."""
    shares = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns]
    total = shares[0]
    for s in shares[1:]:
        total = total + s
    return df.agg(F.coalesce(total / len(shares), F.lit(0.0)).alias("missing_ratio"))


def _range_text(col: str) -> Column:
    return F.coalesce(F.concat(F.date_format(F.min(col), "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.max(col), "yyyy-MM-dd")), F.lit("N/A"))


def date_range(df: DataFrame, col: str = "date") -> DataFrame:
    return df.agg(_range_text(col).alias("date_range"))


def data_quality(universe: DataFrame, valuation: DataFrame, ohlcv: DataFrame, requested: DataFrame, failed: DataFrame) -> DataFrame:
    """metric, value: sizes, coverage and date range, as text."""
    row = (
        universe.agg(F.countDistinct("ticker").alias("universe_total_tickers"), F.count(F.lit(1)).alias("universe_rows"))
        .join(valuation.agg(F.count(F.lit(1)).alias("valuation_rows")))
        .join(ohlcv.agg(F.countDistinct("ticker").alias("ohlcv_successful_tickers"), F.count(F.lit(1)).alias("ohlcv_rows"), _range_text("date").alias("ohlcv_date_range")))
        .join(requested.agg(F.countDistinct("ticker").alias("ohlcv_requested_tickers")))
        .join(failed.agg(F.countDistinct("ticker").alias("ohlcv_failed_tickers")))
    )
    share = F.when(F.col("universe_total_tickers") > 0, F.col("ohlcv_successful_tickers") / F.col("universe_total_tickers")).otherwise(0.0)
    row = row.withColumn("ohlcv_coverage_ratio", F.format_string("%.4f", rounded(share, 4)))
    return row.select(*(F.col(c).cast("string").alias(c) for c in row.columns)).unpivot([], row.columns, "metric", "value")


def factor_alignment(factor: DataFrame, bars: DataFrame, value: str = "value") -> DataFrame:
    """Does a (date, ticker, value) factor lie on the panel's dates and tickers, once each?"""
    def shared(c: str) -> DataFrame:
        own = factor.select(c).distinct()
        found = own.join(bars.select(c).distinct().withColumn("_in", F.lit(1)), c, "left")
        return found.agg(F.count(F.lit(1)).alias(f"n_{c}"), F.coalesce(F.sum("_in"), F.lit(0)).alias(f"shared_{c}s"))

    twice = factor.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("v"))
    cells = twice.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("has_duplicates"), F.coalesce(F.sum("v"), F.lit(0)).alias("_filled"))
    row = shared("date").join(shared("ticker")).join(cells)
    # a cell without a row is missing, too
    size = F.col("n_date") * F.col("n_ticker")
    missing = F.when(size > 0, 1 - F.col("_filled") / size).otherwise(0.0)
    aligned = ~F.col("has_duplicates") & (F.col("n_date") == F.col("shared_dates")) & (F.col("n_ticker") == F.col("shared_tickers"))
    return row.select(aligned.alias("is_aligned"), "has_duplicates", missing.alias("missing_ratio"), "shared_dates", "shared_tickers")


def factor_readiness(factor: DataFrame, bars: DataFrame, value: str = "value") -> DataFrame:
    """Are all dates and assets of the factor priced, and neither side empty?"""
    row = factor_alignment(factor, bars, value).join(factor.agg((F.count(F.lit(1)) > 0).alias("_f"))).join(bars.agg((F.count(F.lit(1)) > 0).alias("_b")))
    own = factor.agg(F.countDistinct("date").alias("_d"), F.countDistinct("ticker").alias("_t"))
    ready = F.col("_f") & F.col("_b") & (F.col("_d") == F.col("shared_dates")) & (F.col("_t") == F.col("shared_tickers"))
    return row.join(own).select(ready.alias("is_ready"), "shared_dates", F.col("shared_tickers").alias("shared_assets"))


def lookahead_check(bars: DataFrame, factor_fn: Callable[[DataFrame], DataFrame], value: str, cut: Column, lookback: int) -> DataFrame:
    """One row: rows, and how many values up to ``cut`` change when the bars after it are dropped (none may)."""
    full = factor_fn(bars).where(F.col("date") <= cut).select("date", "ticker", F.col(value).alias("a"))
    past = factor_fn(bars.where(F.col("date") <= cut)).select("date", "ticker", F.col(value).alias("b"), F.lit(True).alias("_in"))
    # grid rows of tickers that first appear later exist on one side only; they are null there
    both = full.join(past, ["date", "ticker"], "left")
    changed = F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(changed, F.lit(0)).alias("changed")).select(((F.lit(lookback) > 0) & (F.col("rows") > 0) & (F.col("changed") == 0)).alias("is_backward_looking"), F.lit(lookback).alias("lookback"), "rows", "changed")


def _against_cuts(bars: DataFrame, factor_fn: Callable[[DataFrame], DataFrame], value: str, cuts: DataFrame) -> DataFrame:
    """date, ticker, cut, full, and _changed for each value up to each cut: does it differ when the bars after the cut are missing?

    All cuts are one panel: each gets tickers of its own, with that cut's bars, next to the full ones, so ``factor_fn`` runs once. It must be a factor of a ticker's own bars.
    """
    name = F.concat_ws("|", F.coalesce(F.date_format("_cut", "yyyy-MM-dd"), F.lit("")), F.col("ticker"))
    placed = with_date_idx(bars)
    days = F.broadcast(cuts.select(F.col("cut").cast("date").alias("_cut")).where("_cut is not null").distinct())
    cut_off = placed.join(days, F.col("date") <= F.col("_cut"))
    panel = placed.withColumn("_cut", F.lit(None).cast("date")).unionByName(cut_off).withColumn("ticker", name).drop("_cut")
    made = factor_fn(panel).select("date", F.try_to_date(F.substring_index("ticker", "|", 1)).alias("cut"), F.expr("substring(ticker, instr(ticker, '|') + 1)").alias("ticker"), F.col(value).alias("_value"))
    full = made.where("cut is null").select("date", "ticker", F.col("_value").alias("full"))
    past = made.where("cut is not null and date <= cut")
    # cells of a grid that only one side has are null on the other
    both = full.join(days.withColumnRenamed("_cut", "cut"), F.col("date") <= F.col("cut")).join(past, ["date", "ticker", "cut"], "left")
    return both.select("date", "ticker", "cut", "full", (~F.col("full").eqNullSafe(F.col("_value"))).alias("_changed"))


def latest_reads(bars: DataFrame, factor_fn: Callable[[DataFrame], DataFrame], value: str, cuts: DataFrame) -> DataFrame:
    """Provenance of each value: date, ticker, value and latest_read, the first of the cuts (column cut) on or after its date from which on nothing changes it; null if even the last one does, or if no cut follows.

    A value that reads the past alone has the first cut after it; a later one means that it has read bars up to there.
    """
    seen = _against_cuts(bars, factor_fn, value, cuts)
    last = F.max(F.when(F.col("_changed"), F.col("cut")))
    rows = seen.groupBy("date", "ticker").agg(F.first("full").alias(value), last.alias("_bad"), F.array_sort(F.collect_set("cut")).alias("_cuts"))  # as many entries as cuts
    after = F.filter("_cuts", lambda c: F.col("_bad").isNull() | (c > F.col("_bad")))
    return rows.select("date", "ticker", value, F.get(after, F.lit(0)).alias("latest_read"), (F.col("_bad").isNotNull()).alias("leaks"))


def lookahead_checks(bars: DataFrame, factor_fn: Callable[[DataFrame], DataFrame], value: str, cuts: DataFrame, lookback: int) -> DataFrame:
    """``lookahead_check`` for many cuts in one plan: a row per cut."""
    rows = _against_cuts(bars, factor_fn, value, cuts).groupBy("cut").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_changed").alias("changed"))
    return rows.select("cut", ((F.lit(lookback) > 0) & (F.col("rows") > 0) & (F.col("changed") == 0)).alias("is_backward_looking"), F.lit(lookback).alias("lookback"), "rows", "changed")


def snapshot_limitation(valuation: DataFrame) -> DataFrame:
    if "date" not in valuation.columns:
        return valuation.agg(F.lit(DATED).alias("limitation"))
    return valuation.agg(F.when(F.count("date") == 0, LIMITED).otherwise(DATED).alias("limitation"))


def composite_breakdown(composite: DataFrame) -> DataFrame:
    """Rows, dates and readiness per composite type."""
    rows = composite.groupBy("composite_type").agg(F.count(F.lit(1)).alias("n_rows"), _range_text("date").alias("date_range"), F.max("is_snapshot_component_used").alias("is_snapshot_component_used"))
    return rows.withColumn("historical_backtest_ready", ~F.col("is_snapshot_component_used"))


def artifact_shapes(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and distinct tickers of each named frame."""
    out = None
    for name, df in frames.items():
        tickers = F.countDistinct("ticker") if "ticker" in df.columns else F.lit(None).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), tickers.alias("n_tickers")).select(F.lit(name).alias("artifact"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_tickers")
        out = row if out is None else out.unionByName(row)
    return out
