"""The factor scoreboard, the gates before a backtest, and the scores it may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.operators.factors import HISTORICAL

# Factors that may be traded, factors that only describe the present, and note texts.
ELIGIBLE = ["momentum_60d", "low_volatility_20d", "volume_ratio_5d_60d", "historical_price_volume"]
SNAPSHOT = ["pb_inverse", "pe_inverse", "dividend_yield", "latest_snapshot_mixed"]
NOTE_SNAPSHOT, NOTE_WEAK, NOTE_COVERAGE = "excluded: snapshot-only valuation semantics", "weak monotonicity warning", "limited OHLCV coverage: {} tickers"


def best_ic(ic_summary: DataFrame) -> DataFrame:
    """Per factor the row with the highest signed IR; nulls last, ties to the shortest horizon."""
    order = Window.partitionBy("factor").orderBy(F.col("ir").desc_nulls_last(), "horizon")
    return ic_summary.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("factor", "horizon", "ic_mean", "ic_std", "ir")


def maxmin_spread(qr: DataFrame) -> DataFrame:
    return qr.groupBy("factor", "horizon").agg((F.max("mean_return") - F.min("mean_return")).alias("top_bottom_spread"))


def factor_scoreboard(ic: DataFrame, qr: DataFrame, turnover: DataFrame, mono: DataFrame, n_tickers: int | None = None) -> DataFrame:
    """One row per factor that any table names, and per snapshot factor."""
    best, spread = best_ic(ic), maxmin_spread(qr)
    snapshot = ic.sparkSession.createDataFrame([(s,) for s in SNAPSHOT], "factor string")
    names = snapshot
    for table in (best, spread, turnover, mono):
        names = names.unionByName(table.select("factor").where("factor is not null"))
    rows = (
        names.distinct()
        .join(best.withColumnRenamed("horizon", "best_horizon").withColumn("_has_ic", F.lit(True)), "factor", "left")
        .join(spread.withColumnRenamed("horizon", "best_horizon"), ["factor", "best_horizon"], "left")
        .join(turnover.select("factor", F.col("average_best_bucket_turnover").alias("avg_turnover")), "factor", "left")
        .join(mono.select("factor", F.col("horizon").alias("best_horizon"), F.col("adjacent_agreement_ratio").alias("monotonicity_score"), F.col("monotonicity_pass").alias("_pass")), ["factor", "best_horizon"], "left")
    )
    is_snapshot = F.col("factor").isin(SNAPSHOT)
    ready = F.col("factor").isin(ELIGIBLE) & F.coalesce("_has_ic", F.lit(False))
    notes = F.concat_ws("; ", F.when(is_snapshot, NOTE_SNAPSHOT), F.when(~F.col("_pass"), NOTE_WEAK), F.lit(None if n_tickers is None else NOTE_COVERAGE.format(n_tickers)).cast("string"))
    return rows.select(
        "factor", "best_horizon", "ic_mean", "ic_std", "ir", "top_bottom_spread", "avg_turnover", "monotonicity_score",
        F.coalesce("_pass", F.lit(False)).alias("monotonicity_pass"), ready.alias("is_historical_ready"), (ready & ~is_snapshot).alias("is_backtest_candidate"), notes.alias("notes"),
    )


def eligible_factors(scoreboard: DataFrame) -> DataFrame:
    return scoreboard.where("is_backtest_candidate").select("factor")


def require_factor(scoreboard: DataFrame, requested: str | None = None) -> str:
    """The factor to trade, or an error if the scoreboard does not allow it."""
    name = requested or HISTORICAL
    if eligible_factors(scoreboard).where(F.col("factor") == name).isEmpty():
        raise ValueError(f"Requested factor is not backtest eligible: {name}")
    return name


def require_not_snapshot(name: str) -> str:
    """For scheduled runs: snapshot factors are an error, unknown names pass."""
    if name in SNAPSHOT:
        raise ValueError(f"Snapshot-only factor cannot be scheduled: {name}")
    return name


def readiness(bars: DataFrame, min_tickers: int) -> DataFrame:
    """Number of tickers and whether it suffices."""
    return bars.agg(F.countDistinct("ticker").alias("ticker_count")).withColumn("min_tickers", F.lit(min_tickers)).withColumn("is_ready", F.col("ticker_count") >= min_tickers)


def require_ready(bars: DataFrame, min_tickers: int) -> None:
    row = readiness(bars, min_tickers).first()
    if not row["is_ready"]:
        raise RuntimeError(f"Backtest universe too small: {row['ticker_count']} < {min_tickers}")


def selected_factor_scores(composite: DataFrame, factor: str = HISTORICAL) -> DataFrame:
    return composite.where((F.col("composite_type") == factor) & ~F.col("is_snapshot_component_used"))
