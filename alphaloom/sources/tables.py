"""Sources and sinks: guarded Parquet, landed JSON, vendor bars, ticker selection and the artifact manifest."""

from __future__ import annotations

import os
import random
import re
import tempfile
import time
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions.scalars import clean_ticker, day_first, numeric, to_date_lenient
from alphaloom.sources.json_arrays import read_landed_json  # noqa: F401

MANIFEST = "artifact_name string, path string, row_count long, column_count long, source_inputs array<string>, schema_version string, created_at string, notes string"
BARS = ["date", "ticker", "open", "high", "low", "close", "volume"]

# Headers under which a field may arrive, first match wins.
UNIVERSE_ALIASES = {
    "ticker": ["ticker", "code", "stock_code", "證券代號", "股票代號", "公司代號"],
    "company_name": ["company_name", "name", "公司名稱", "股票名稱"],
    "industry": ["industry", "industry_category", "產業別"],
    "market": ["market", "市場別", "上市別"],
    "listed_date": ["listed_date", "listeddate", "上市日期"],
}
VALUATION_ALIASES = {
    "date": ["date", "日期", "資料日期"],
    "ticker": ["ticker", "code", "股票代號"],
    "pe": ["pe", "peratio", "pe_ratio", "本益比"],
    "pb": ["pb", "pbratio", "pb_ratio", "股價淨值比"],
    "dividend_yield": ["dividend_yield", "dividendyield", "殖利率", "股利殖利率"],
}
OHLCV_ALIASES = {"date": ["date", "datetime", "日期"], "ticker": ["ticker", "code", "股票代號"], "open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"], "volume": ["volume"]}


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save(df: DataFrame, path: str) -> str:
    """Write Parquet; an empty frame is an error, as a downstream job would read it as success."""
    if df.isEmpty():
        raise ValueError("Cannot save empty DataFrame to Parquet")
    df.write.mode("overwrite").parquet(path)
    return path


def _snake(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"[^0-9a-zA-Z一-鿿]+", "_", spaced).strip("_").lower()


def resolve_column(df: DataFrame, candidates: list[str]) -> Column:
    """The first of ``candidates`` among the headers, compared in snake case, then without underscores; a null column if there is none."""
    names = {_snake(c): c for c in reversed(df.columns)}
    compact = {k.replace("_", ""): v for k, v in names.items()}
    for alias in map(_snake, candidates):
        found = names.get(alias) or compact.get(alias.replace("_", ""))
        if found:
            return F.col(f"`{found}`")
    return F.lit(None).cast("string")


def normalize_universe(df: DataFrame) -> DataFrame:
    """ticker, company_name, industry, market (blank means TWSE), listed_date."""
    raw = {f: resolve_column(df, names) for f, names in UNIVERSE_ALIASES.items()}
    market = raw["market"].cast("string")
    df, days_lead = _voted(df, raw["listed_date"])
    return df.select(
        clean_ticker(raw["ticker"]).alias("ticker"),
        raw["company_name"].cast("string").alias("company_name"),
        raw["industry"].cast("string").alias("industry"),
        F.coalesce(F.when(market != "", market), F.lit("TWSE")).alias("market"),
        to_date_lenient(raw["listed_date"], days_lead).alias("listed_date"),
    )


def _voted(df: DataFrame, raw: Column) -> tuple[DataFrame, Column]:
    """``df`` with one column more, the same in all rows: do days lead in the dates of ``raw``?"""
    return df.join(F.broadcast(df.agg(day_first(raw).alias("_days_lead")))), F.col("_days_lead")  # one row


def _dated(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """date, ticker and numbers, by their aliases."""
    raw = {f: resolve_column(df, names) for f, names in aliases.items()}
    values = [numeric(c).alias(f) for f, c in raw.items() if f not in ("date", "ticker")]
    df, days_lead = _voted(df, raw["date"])
    return df.select(to_date_lenient(raw["date"], days_lead).alias("date"), clean_ticker(raw["ticker"]).alias("ticker"), *values)


def normalize_valuation(df: DataFrame) -> DataFrame:
    """date, ticker, pe, pb, dividend_yield."""
    return _dated(df, VALUATION_ALIASES)


def normalize_ohlcv(df: DataFrame) -> DataFrame:
    """date, ticker, open, high, low, close, volume."""
    return _dated(df, OHLCV_ALIASES)


def format_bars(raw: DataFrame, ticker: Column | str) -> DataFrame:
    """Vendor bars: lower-case names, a ticker column, known columns only (an adjusted close goes)."""
    lower = {c.strip().lower(): c for c in raw.columns}
    if "datetime" in lower and "date" not in lower:
        lower["date"] = lower["datetime"]
    tag = F.lit(ticker) if isinstance(ticker, str) else ticker
    return raw.select(*(tag.alias("ticker") if c == "ticker" else F.col(f"`{lower[c]}`").alias(c) for c in BARS if c == "ticker" or c in lower))


def failed_tickers(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Requested tickers without a row, once each."""
    return requested.select("ticker").where("ticker is not null").join(received.select("ticker"), "ticker", "left_anti").distinct()


def select_tickers(universe: DataFrame, limit: int | str | None = None, order_col: str = "ticker") -> DataFrame:
    """Distinct non-null tickers in the order of their first ``order_col``; the first ``limit`` of them, all if None or "all"."""
    first = universe.where("ticker is not null").groupBy(F.col("ticker").cast("string").alias("ticker")).agg(F.min(order_col).alias("_o"))
    ordered = first.orderBy("_o", "ticker")
    return (ordered if limit in (None, "all") else ordered.limit(int(limit))).select("ticker")


def manifest(frames: dict[str, DataFrame], schema_version: str, sources: dict[str, list[str]] | None = None, created_at: str | None = None, notes: str = "") -> DataFrame:
    """One row per named frame: rows, columns and lineage, stamped with the time if none is given; counts run as one query."""
    created_at = datetime.now(UTC).isoformat() if created_at is None else created_at
    parts = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("artifact_name"), F.lit(f"{name}.parquet").alias("path"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
            F.array(*(F.lit(s) for s in (sources or {}).get(name, []))).cast("array<string>").alias("source_inputs"), F.lit(schema_version).alias("schema_version"), F.lit(created_at).alias("created_at"), F.lit(notes).alias("notes"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def manifest_upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by artifact_name; the last one wins, a new one over a current one."""
    both = current.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    last = Window.partitionBy("artifact_name").orderBy(F.desc("_v"), F.desc("created_at"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_v")


def _store(spark: SparkSession, path: str):
    """File system and path, in any store that Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with ``text``, whole, unless there is one; one of several writers at most is told True.

    A mount is followed to the store behind it. Local folders and HDFS have a step that makes a finished file
    appear under a name that is free (a hard link, a rename), so a writer that dies leaves no half of one. Other stores
    are trusted to create exclusively.
    """
    store, hadoop = _store(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.resolvePath(hadoop.getParent()), hadoop.getName())
    store, scheme = _store(spark, hadoop.toString())[0], hadoop.toUri().getScheme()
    if scheme == "file":
        own = hadoop.toUri().getPath()
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(own), prefix=".") as made:
            made.write(text)
            made.flush()
            try:
                os.link(made.name, own)
            except FileExistsError:
                return False
        return True
    first = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{uuid.uuid4().hex}") if scheme == "hdfs" else hadoop
    try:
        out = store.create(first, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    if scheme == "hdfs" and not store.rename(first, hadoop):  # false where the name is taken
        store.delete(first, False)
        return False
    return True


def _latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of a manifest's latest version; 0 if there is none. A file that is still empty is being written."""
    store, hadoop = _store(spark, f"{path}/versions")
    files = [f for f in (store.listStatus(hadoop) if store.exists(hadoop) else []) if f.getPath().getName().isdigit() and f.getLen()]
    if not files:
        return 0, None
    last = max(files, key=lambda f: int(f.getPath().getName())).getPath()
    return int(last.getName()), spark.read.text(last.toString()).first()["value"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the latest version; no entries if nothing was written yet."""
    _, folder = _latest(spark, path)
    return spark.read.schema(MANIFEST).json(f"{path}/{folder}") if folder else spark.createDataFrame([], MANIFEST)


def append_manifest(spark: SparkSession, path: str, entries: DataFrame, tries: int = 50) -> DataFrame:
    """Merge ``entries`` into the stored manifest, by artifact_name, as a new version of it; readers never see half of one.

    Writers may come together: a version is a file that only one of them can make, naming the folder of its
    entries. Who comes late takes what the other wrote, merges again and tries for the next number, so no entry is lost.
    """
    store, hadoop = _store(spark, f"{path}/versions")
    store.mkdirs(hadoop)
    for k in range(tries):
        number, _ = _latest(spark, path)
        folder = f"entries-{uuid.uuid4().hex}"
        manifest_upsert(read_manifest(spark, path), entries).coalesce(1).write.json(f"{path}/{folder}")
        if _latest(spark, path)[0] == number and _put_if_absent(spark, f"{path}/versions/{number + 1:08}", folder):
            return spark.read.schema(MANIFEST).json(f"{path}/{folder}")
        own, made = _store(spark, f"{path}/{folder}")
        own.delete(made, True)
        time.sleep(random.uniform(0, 0.05 * (k + 1)))
    raise RuntimeError(f"manifest {path}: other writers came first {tries} times")
