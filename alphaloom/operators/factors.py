"""Rolling price and volume factors, snapshot valuation factors and rank composites.

Windows are RANGE frames over date_idx within a ticker: a frame of n positions is n rows of the dense
matrix, without making the rows. Several factors share one window specification, so a ticker's bars
are shuffled and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from alphaloom.functions.scalars import HIGHER, LOWER, ratio, rounded, with_pct_ranks
from alphaloom.operators.panel import date_index, with_date_idx

# Composite weights and directions.
PRICE_VOLUME_WEIGHTS = {"momentum_60d": 0.20, "low_volatility_20d": 0.15, "volume_ratio_5d_60d": 0.15}
VALUATION_WEIGHTS = {"pb_inverse": 0.20, "pe_inverse": 0.15, "dividend_yield": 0.15}
DIRECTIONS = {"momentum_60d": HIGHER, "low_volatility_20d": LOWER, "volume_ratio_5d_60d": HIGHER, "pb_inverse": HIGHER, "pe_inverse": HIGHER, "dividend_yield": HIGHER}
HISTORICAL, MIXED = "historical_price_volume", "latest_snapshot_mixed"

def _time() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date_idx")


def _at(c: str, shift: int) -> Column:
    """The value ``shift`` positions away; null if there is no row."""
    return F.max(c).over(_time().rangeBetween(shift, shift))


def _rolling(f, c: str, n: int) -> Column:
    """An aggregate over n positions, null unless all have a value."""
    frame = _time().rangeBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) == n, f(c).over(frame))


def momentum(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """close now over close ``lookback`` positions ago, less one."""
    df = with_date_idx(bars)
    return df.select("date", "ticker", (ratio(F.col("close"), _at("close", -lookback)) - 1).alias("momentum"))


def _stepped(bars: DataFrame, n: int, at_bar: dict[str, Column] | None = None) -> DataFrame:
    """Bars, and between them the positions at which a window of n padded returns changes: where a bar leaves it, and behind a close of zero.

    ticker, date_idx, close, and ``at_bar`` values, which are made while bars are the only rows; _bar tells the rows that were there, and
    in the rest all is null. No ticker has more than three rows per bar, whatever its gaps. A ticker is dealt out once, and its steps are sorted where it is.
    """
    at_bar = at_bar or {}
    there = {"_after": _at("date_idx", n), "_then": _at("date_idx", 1)}
    df = with_date_idx(bars).where("ticker is not null").select("ticker", "date_idx", "close", *(c.alias(name) for name, c in (at_bar | there).items()))
    own = [f for f in df.schema.fields if f.name not in ("ticker", "date_idx", *there)]

    def row(at: Column, bar: bool) -> Column:
        return F.struct(at.cast("int").alias("date_idx"), F.lit(bar).alias("_bar"), *((F.col(f.name) if bar else F.lit(None).cast(f.dataType)).alias(f.name) for f in own))

    at = F.col("date_idx")
    steps = F.array(row(at, True), F.when(F.col("_after").isNull(), row(at + n, False)), F.when((F.col("close") == 0) & F.col("_then").isNull(), row(at + 1, False)))
    return df.select("ticker", F.inline(steps)).where("_bar is not null")


def _padded_volatility(steps: DataFrame, n: int) -> DataFrame:
    """``steps`` with _vol, the deviation of n returns up to each row, closes carried over gaps.

    A gap's returns are zero, so they enter a window's moments by their number alone; those behind a close of zero are undefined.
    """
    before = F.last("close", ignorenulls=True).over(_time().rangeBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("_before", before)
    steps = steps.withColumns({"_ret": F.when(F.col("close").isNotNull(), ratio(F.col("close"), F.col("_before")) - 1), "_bad": F.when(F.col("_before") == 0, 1), "_priced": F.when(F.col("close").isNotNull(), F.col("date_idx"))})
    frame = _time().rangeBetween(1 - n, 0)
    k, mean = F.count("_ret").over(frame), F.coalesce(F.avg("_ret").over(frame), F.lit(0.0))
    squares = F.coalesce(F.var_pop("_ret").over(frame), F.lit(0.0)) * k + mean * mean * k * (n - k) / n
    whole = (F.col("date_idx") - n >= F.min("_priced").over(_time().rangeBetween(Window.unboundedPreceding, 0))) & (F.count("_bad").over(frame) == 0)
    return steps.withColumn("_vol", F.when(whole, F.sqrt(squares / (n - 1)))).drop("_before", "_ret", "_bad", "_priced")


def _cells(steps: DataFrame, bars: DataFrame, at_bar: dict[str, Column], held: dict[str, Column]) -> DataFrame:
    """A row for every date and ticker: ``at_bar`` values on the rows of bars alone, ``held`` ones from each row up to the next.

    Cells are spread out last, row by row; dates are joined as a small table.
    """
    dates = date_index(bars)
    steps = steps.select("ticker", "date_idx", "_bar", *(c.alias(name) for name, c in (at_bar | held).items()), F.lag("date_idx").over(_time()).alias("_last"), F.lead("date_idx").over(_time()).alias("_next"))
    steps = steps.join(F.broadcast(dates.agg(F.max("date_idx").alias("_end"))))  # one row
    low = F.when(F.col("_last").isNull(), 1).otherwise(F.col("date_idx"))
    high = F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("_end"))
    # rows of one position (two steps) give cells once
    spread = steps.where(F.coalesce(F.col("_next") > F.col("date_idx"), F.lit(True)) & (low <= high)).withColumn("_at", F.explode(F.sequence(low, high)))
    mine = (F.col("_at") == F.col("date_idx")) & F.col("_bar")
    values = [F.when(mine, F.col(c)).alias(c) for c in at_bar] + [F.when(F.col("_at") >= F.col("date_idx"), F.col(c)).alias(c) for c in held]
    named = spread.select(F.col("_at").alias("date_idx"), "ticker", *values).join(F.broadcast(dates), "date_idx")
    return named.select("date", "ticker", *at_bar, *held)


def return_volatility(bars: DataFrame, n: int = 20, fill: str = "pad") -> DataFrame:
    """Sample deviation of n returns at every date and ticker; ``fill`` "pad" carries the last close over gaps, "none" leaves them. Bars have distinct keys (see ``validate_panel``)."""
    steps = _stepped(bars, n)
    if fill == "pad":
        steps = _padded_volatility(steps, n)
    else:
        # all n closes and the one before them are there: rows of bars alone
        steps = steps.withColumn("_ret", ratio(F.col("close"), _at("close", -1)) - 1)
        steps = steps.withColumn("_vol", _rolling(F.stddev_samp, "_ret", n))
    return _cells(steps, bars, {}, {"return_volatility": F.col("_vol")})


def _true_range() -> Column:
    prev = _at("close", -1)
    parts = [F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.greatest(*parts))


def atr_over_close(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean true range of n positions over close; a true range needs high, low and the previous close."""
    df = with_date_idx(bars).withColumn("tr", _true_range())
    return df.select("date", "ticker", ratio(_rolling(F.avg, "tr", n), F.col("close")).alias("atr_over_close"))


def low_volatility_method(bars: DataFrame) -> DataFrame:
    """One row: "atr_20d_over_close" if there is a high and a low, else "return_volatility_20d"."""
    have = [F.count(c) if c in bars.columns else F.lit(0).cast("long") for c in ("high", "low")]
    return bars.agg(F.when((have[0] > 0) & (have[1] > 0), "atr_20d_over_close").otherwise("return_volatility_20d").alias("method"))


def volume_ratio(bars: DataFrame, short: int = 5, long: int = 60) -> DataFrame:
    """Mean volume of the short window over that of the long one."""
    df = with_date_idx(bars)
    return df.select("date", "ticker", ratio(_rolling(F.avg, "volume", short), _rolling(F.avg, "volume", long)).alias("volume_ratio"))


def price_volume_factors(bars: DataFrame, cells: bool = True) -> DataFrame:
    """The three factors for every cell of the grid, from one window stage; without highs or lows (no column, or all null) returns give the volatility.

    A true range gives no value but at a bar. There, without ``cells``, the rows of bars are all: what ranks, selections and correlations need.
    """
    momentum_60d = ratio(F.col("close"), _at("close", -60)) - 1
    volume_ratio_5d_60d = ratio(_rolling(F.avg, "volume", 5), _rolling(F.avg, "volume", 60))
    if {"high", "low"} <= set(bars.columns) and low_volatility_method(bars).first()["method"] == "atr_20d_over_close":
        steps = with_date_idx(bars).where("ticker is not null").withColumn("_bar", F.lit(True)).withColumn("tr", _true_range())
        values = {"momentum_60d": momentum_60d, "low_volatility_20d": ratio(_rolling(F.avg, "tr", 20), F.col("close")), "volume_ratio_5d_60d": volume_ratio_5d_60d}
        return _cells(steps, bars, values, {}) if cells else steps.select("date", "ticker", *(c.alias(name) for name, c in values.items()))
    # volume and momentum have values at bars alone, so their frames don't meet the steps between
    steps = _padded_volatility(_stepped(bars, 20, {"momentum_60d": momentum_60d, "volume_ratio_5d_60d": volume_ratio_5d_60d}), 20)
    out = _cells(steps, bars, {c: F.col(c) for c in ("momentum_60d", "volume_ratio_5d_60d")}, {"low_volatility_20d": F.col("_vol")})
    return out.select("date", "ticker", "momentum_60d", "low_volatility_20d", "volume_ratio_5d_60d")


def valuation_factors(valuation: DataFrame, default_as_of: str) -> DataFrame:
    """Inverse price ratios where positive; as_of_date is the latest valuation date, or the given one if all are null."""

    def inverse(c: str) -> Column:
        return F.when(F.col(c) > 0, 1.0 / F.col(c))

    as_of = valuation.agg(F.coalesce(F.max(F.col("date").cast("date")), F.lit(default_as_of).cast("date")).alias("as_of_date"))
    return valuation.join(F.broadcast(as_of)).select(F.col("date").cast("date").alias("date"), "as_of_date", "ticker", inverse("pb").alias("pb_inverse"), inverse("pe").alias("pe_inverse"), "dividend_yield", F.lit(True).alias("is_snapshot"))


def weighted_rank(df: DataFrame, weights: dict[str, float], directions: dict[str, str] = DIRECTIONS, by: str = "date") -> DataFrame:
    """``df`` with composite_score: the weighted mean of percentile ranks over the factors that are not null.

    Rows without any value, most cells of a sparse grid, have no rank: they are neither dealt out nor sorted.
    """
    if not weights:
        raise ValueError("No factors to combine")
    # ten digits first: ties must not hang on the order of a sum
    ranked = df.select("*", *(rounded(F.col(f), 10).alias(f"_v_{f}") for f in weights))
    valued = F.coalesce(*(F.col(f"_v_{f}") for f in weights)).isNotNull()
    none = ranked.where(~valued).select(*(F.col(c) for c in df.columns), F.lit(None).cast("double").alias("composite_score"))
    ranked = with_pct_ranks(ranked.where(valued), [by], {f"_r_{f}": (f"_v_{f}", directions[f]) for f in weights})
    top, low = F.lit(0.0), F.lit(0.0)
    for f, w in weights.items():
        r = F.col(f"_r_{f}")
        top, low = top + F.coalesce(r * w, F.lit(0.0)), low + F.when(r.isNotNull(), w).otherwise(0.0)
    return ranked.select(*(F.col(c) for c in df.columns), ratio(top, F.when(low > 0, low)).alias("composite_score")).union(none)


def _composite(df: DataFrame, kind: str, used: bool) -> DataFrame:
    return df.select("date", "ticker", "composite_score", F.lit(kind).alias("composite_type"), F.lit(used).alias("is_snapshot_component_used"))


def historical_composite(pv: DataFrame) -> DataFrame:
    return _composite(weighted_rank(pv, PRICE_VOLUME_WEIGHTS), HISTORICAL, False)


def mixed_composite(pv: DataFrame, valuation: DataFrame) -> DataFrame:
    """The latest price factors, re-dated to the valuation's as_of_date, with its factors."""
    last = pv.agg(F.max("date").alias("_last"))
    as_of = valuation.agg(F.first("as_of_date").alias("_as_of"))
    latest = pv.join(F.broadcast(last)).where("date = _last").join(F.broadcast(as_of)).withColumn("date", F.col("_as_of").cast("date")).drop("_last", "_as_of")
    values = valuation.select(F.col("as_of_date").alias("date"), "ticker", *VALUATION_WEIGHTS)
    return _composite(weighted_rank(latest.join(values, ["date", "ticker"], "left"), PRICE_VOLUME_WEIGHTS | VALUATION_WEIGHTS), MIXED, True)


def composite_frame(pv: DataFrame, valuation: DataFrame) -> DataFrame:
    return historical_composite(pv).unionByName(mixed_composite(pv, valuation))
