"""Bars and valuations derived from the order tables, which hold no prices of their own.

A line's unit price stands for a trade. Brands are tickers; dates are ISO weeks
(bars_w) or weekdays (bars_d). Sums are made in whole cents, so they do not hang on the order
of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.functions.scalars import rounded

AS_OF = "1998-12-31"
CUT = "1996-06-30"
CUTS = ["1993-06-30", "1993-07-12", "1995-01-02", "1996-06-30", "1997-12-31"]
#: Added to all prices: lines of one brand differ too much in price to pass for one asset's moves.
LEVEL = 100_000


def _trades(spark: SparkSession, sf_dir: str, ticker: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("day"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(ticker).alias("ticker"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("day", "ticker", F.round("l_quantity").cast("long").alias("q"), cents.alias("c"))


def _bars(trades: DataFrame, date: Column) -> DataFrame:
    price = F.col("c") / F.col("q") / 100 + LEVEL
    rows = trades.groupBy(date.alias("date"), "ticker").agg(F.max(price).alias("high"), F.min(price).alias("low"), F.sum("c").alias("c"), F.sum("q").alias("q"))
    close = rounded(price, 4)
    return rows.select("date", "ticker", rounded((F.col("high") + F.col("low")) / 2, 4).alias("open"), "high", "low", close.alias("close"), F.col("q").cast("double").alias("volume"))


def bars_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_trades(spark, sf_dir, "p_brand"), F.date_trunc("week", "day").cast("date"))


def _weekday(trades: DataFrame) -> DataFrame:
    return _bars(trades.where(F.weekday("day") < 5), F.col("day"))


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekday(_trades(spark, sf_dir, "p_brand"))


def bars_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by supplier for every day: a panel whose tickers grow with the tables."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    trades = lines.select(F.col("l_shipdate").cast("date").alias("day"), F.col("l_suppkey").cast("string").alias("ticker"), F.round("l_quantity").cast("long").alias("q"), price.alias("c"))
    return _bars(trades, F.col("day"))


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot without dates, by brand; some price ratios are not positive."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    cents = F.sum(F.round(F.col("p_retailprice") * 100).cast("long"))
    n = F.count(F.lit(1))
    return parts.groupBy(F.col("p_brand").alias("ticker")).agg(
        F.lit(None).cast("date").alias("date"),
        rounded(F.sum("p_size") / n - 25, 4).alias("pe"),
        rounded(cents / n / 100000, 4).alias("pb"),
        rounded(F.sum(F.col("p_size") % 7) / n, 4).alias("dividend_yield"),
    )


def raw_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a listing under vendor headers, with blanks and untidy codes."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    code = F.when(key % 5 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit(".tw "))).when(key % 7 == 0, F.concat(F.lit("fund"), F.lit(".TW"))).otherwise(F.lpad(key.cast("string"), 6, "0"))
    date = F.when(key % 3 == 0, "19620209").when(key % 3 == 1, "1994-09-05").otherwise("n/a")
    return s.select(code.alias("StockCode"), F.col("s_name").alias("Name"), F.col("s_nationkey").cast("string").alias("產業別"), F.when(key % 2 == 0, "").alias("Market"), date.alias("ListedDate"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as vendor bars in text, with thousands separators and missing marks."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    mark = F.col("l_linenumber") % 4
    text = F.when(mark == 0, "--").when(mark == 1, F.concat(F.floor(price / 1000).cast("string"), F.lit(","), F.lpad((price % 1000).cast("string"), 3, "0"))).otherwise(price.cast("string"))
    date = F.when(mark == 2, F.date_format("l_shipdate", "yyyyMMdd")).when(mark == 3, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return t.select(date.alias("Date"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".TW")).alias("Code"), text.alias("Open"), text.alias("High"), text.alias("Low"), F.col("l_quantity").cast("string").alias("Close"), F.lit("1,000").alias("Volume"), F.lit("x").alias("Adj Close"))


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates as vendors write them: one column in many forms, months before days, and one with days before months."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    forms = ["yyyy/MM/dd", "M/d/yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy.M.d", "MM-dd-yyyy HH:mm"]
    kind = F.col("l_linenumber") % (len(forms) + 1)
    mixed = F.when(kind == len(forms), F.lit("13/32/2024"))
    for k, form in enumerate(forms):
        mixed = mixed.when(kind == k, F.date_format("l_shipdate", form))
    return t.select(mixed.alias("mixed"), F.date_format("l_shipdate", "d/M/yyyy").alias("european"))


def raw_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    return p.select(F.lit(None).cast("string").alias("Date"), F.col("p_partkey").cast("string").alias("Code"), F.when(size % 4 == 0, "-").otherwise(size.cast("string")).alias("PEratio"), F.when(size % 3 == 0, "N/A").otherwise(F.col("p_name")).alias("PBratio"), F.concat(F.lit("1,"), F.lpad(size.cast("string"), 3, "0")).alias("DividendYield"))
