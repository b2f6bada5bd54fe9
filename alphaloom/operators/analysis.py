"""Factor analysis on long frames: forward returns, rank IC, quantiles, turnover, monotonicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.scalars import HIGHER, LOWER, average_rank, ratio, rounded
from alphaloom.operators.factors import DIRECTIONS, HISTORICAL
from alphaloom.operators.panel import with_date_idx
from alphaloom.operators.ranks import dealt, must_spread, spread_ranks

FACTOR_DIRECTIONS = {"momentum_60d": HIGHER, "low_volatility_20d": LOWER, "volume_ratio_5d_60d": HIGHER, HISTORICAL: HIGHER}
HISTORICAL_FACTORS = list(FACTOR_DIRECTIONS)
SNAPSHOT_STATUS = "snapshot_only_not_historical_ready"


def historical_factors(pv: DataFrame, composite: DataFrame, names: list[str] = HISTORICAL_FACTORS) -> DataFrame:
    """factor, date, ticker, value for the named factors that exist; the composite joins them if it is named."""
    columns = [n for n in names if n in pv.columns]
    out = pv.unpivot(["date", "ticker"], columns, "factor", "value").select("factor", "date", "ticker", "value") if columns else None
    if HISTORICAL in names:
        own = composite.where(F.col("composite_type") == HISTORICAL).select(F.lit(HISTORICAL).alias("factor"), "date", "ticker", F.col("composite_score").alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def excluded_factors(spark, names: list[str]) -> DataFrame:
    """Snapshot factors with the reason why they take no part."""
    return spark.createDataFrame([(n, SNAPSHOT_STATUS) for n in names], "factor string, status string")


def forward_returns(bars: DataFrame, horizons: list[int] = [1, 5, 20]) -> DataFrame:  # noqa: B006
    """close ``h`` positions ahead over close now, less one, per horizon; one window for all horizons."""
    ahead = Window.partitionBy("ticker").orderBy("date_idx")
    df = with_date_idx(bars).select("date", "ticker", *((ratio(F.max("close").over(ahead.rangeBetween(h, h)), F.col("close")) - 1).alias(str(h)) for h in horizons))
    out = df.unpivot(["date", "ticker"], [str(h) for h in horizons], "horizon", "forward_return").where("forward_return is not null")
    return out.select("date", "ticker", "forward_return", F.col("horizon").cast("int").alias("horizon"))


def rank_ic(factors: DataFrame, fwd: DataFrame, spread: bool | None = None) -> DataFrame:
    """Per factor, horizon and date: correlation of ranks over tickers with both values (two at least); undefined ones are dropped. ``spread``: see ``with_pct_ranks``."""
    both = factors.where("value is not null").join(fwd, ["date", "ticker"])
    group = ["factor", "horizon", "date"]
    both = both.select(*group, rounded(F.col("value"), 10).alias("v"), rounded(F.col("forward_return"), 10).alias("r"))
    if must_spread(both, group) if spread is None else spread:
        first = spread_ranks(both, group, "v").select(*group, "r", F.col("_average").alias("a"))
        ranked = spread_ranks(first, group, "r").select(*group, "a", F.col("_average").alias("b"))
    else:
        ranked = dealt(both, group).select(*group, average_rank(F.col("v"), group).alias("a"), average_rank(F.col("r"), group).alias("b"))
    stats = ranked.groupBy(*group).agg(F.covar_pop("a", "b").alias("c"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("s"), F.count(F.lit(1)).alias("n"))
    return stats.where("n >= 2 and s > 0").select(*group, ratio(F.col("c"), F.col("s")).alias("ic"), F.col("n").cast("int").alias("asset_count"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one date), dates, assets and their ratio, null if the deviation is 0."""
    stats = ic.groupBy("factor", "horizon").agg(F.avg("ic").alias("ic_mean"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"), F.countDistinct("date").cast("int").alias("valid_date_count"), F.avg("asset_count").alias("average_asset_count"))
    return stats.withColumn("ir", ratio(F.col("ic_mean"), F.when(rounded(F.col("ic_std"), 12) > 0, F.col("ic_std"))))


def factor_quantiles(factors: DataFrame, directions: dict[str, str] = FACTOR_DIRECTIONS, q: int = 5, spread: bool | None = None) -> DataFrame:
    """Quantile 1 to q per factor and date, best last; ties by ticker. The cut is floor((rank - 1) * q / n) + 1, not that of ntile. ``spread``: see ``with_pct_ranks``."""
    names = F.create_map(*(F.lit(x) for f, d in {**DIRECTIONS, **directions}.items() for x in (f, -1.0 if d == LOWER else 1.0)))
    kept = factors.where("value is not null").withColumn("_o", rounded(F.col("value"), 10) * F.element_at(names, F.col("factor")))
    if must_spread(kept, ["factor", "date"]) if spread is None else spread:
        kept = spread_ranks(kept, ["factor", "date"], "_o", ties=["ticker"])
        rank, count = F.col("_position"), F.col("_count")
    else:
        kept, group = dealt(kept, ["factor", "date"]), Window.partitionBy("factor", "date")
        rank, count = F.row_number().over(group.orderBy("_o", "ticker")), F.count(F.lit(1)).over(group)
    bucket = F.floor((rank - 1) * q / count) + 1
    return kept.select("factor", "date", "ticker", F.col("value").alias("factor_value"), bucket.cast("int").alias("quantile"))


def quantile_returns(assignments: DataFrame, fwd: DataFrame) -> DataFrame:
    """Pooled mean forward return and members per factor, horizon and quantile."""
    both = assignments.join(fwd, ["date", "ticker"])
    return both.groupBy("factor", "horizon", "quantile").agg(F.avg("forward_return").alias("mean_return"), F.count("ticker").cast("int").alias("member_count"))


def quantile_pivot(qr: DataFrame, q: int = 5) -> DataFrame:
    """Q1 to Qq per factor and horizon, and the last less the first."""
    wide = qr.groupBy("factor", "horizon").pivot("quantile", list(range(1, q + 1))).agg(F.first("mean_return"))
    for k in range(1, q + 1):
        wide = wide.withColumnRenamed(str(k), f"Q{k}")
    return wide.withColumn("top_bottom_spread", F.col(f"Q{q}") - F.col("Q1"))


def bucket_turnover(assignments: DataFrame) -> DataFrame:
    """Per factor: mean share of the best bucket's members that are gone at its next date."""
    best = assignments.groupBy("factor").agg(F.max("quantile").alias("quantile"))
    held = assignments.join(best, ["factor", "quantile"]).select("factor", "quantile", "date", "ticker")
    # positions are made on distinct dates, a small table; a member stays if its next date is the bucket's next date
    by_factor = Window.partitionBy("factor")
    dates = held.select("factor", "date").distinct().withColumn("seq", F.row_number().over(by_factor.orderBy("date"))).withColumn("last", F.max("seq").over(by_factor))
    after = F.lead("seq").over(Window.partitionBy("factor", "ticker").orderBy("seq"))
    stays = F.coalesce(after == F.col("seq") + 1, F.lit(False)).cast("int")
    rows = held.join(dates, ["factor", "date"]).withColumn("stays", stays)
    share = rows.groupBy("factor", "seq").agg(F.first("quantile").alias("best_quantile"), F.first("last").alias("date_count"), (1 - F.avg("stays")).alias("gone"))
    gone = F.when(F.col("seq") < F.col("date_count"), F.col("gone"))
    return share.groupBy("factor").agg(F.first("best_quantile").alias("best_quantile"), F.avg(gone).alias("average_best_bucket_turnover"), F.first("date_count").alias("date_count"))


def monotonicity(qr: DataFrame) -> DataFrame:
    """Share of adjacent quantiles whose mean return does not fall; passed if all; the spread is last less first."""
    order = Window.partitionBy("factor", "horizon").orderBy("quantile")
    # compared at twelve digits: the order of a sum must not decide
    steps = qr.withColumn("_prev", F.lag("mean_return").over(order)).withColumn("_up", F.when(F.col("_prev").isNotNull(), (rounded(F.col("mean_return"), 12) >= rounded(F.col("_prev"), 12)).cast("double")))
    out = steps.groupBy("factor", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("_up").alias("adjacent_agreement_ratio"), (F.max_by("mean_return", "quantile") - F.min_by("mean_return", "quantile")).alias("_spread"))
    passed = F.coalesce(F.col("adjacent_agreement_ratio") == 1.0, F.lit(False))
    # fixed texts
    notes = F.when(F.col("n") < 2, "insufficient quantile buckets").when(passed, "monotonic increasing from Q1 to Q5").otherwise("non-monotonic quantile-return ordering")
    return out.select("factor", "horizon", passed.alias("monotonicity_pass"), "adjacent_agreement_ratio", F.when(F.col("n") >= 2, F.col("_spread")).alias("top_bottom_spread"), notes.alias("notes"))
