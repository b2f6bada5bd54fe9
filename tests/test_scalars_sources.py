"""Cleaning, normalisation, sources and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import scalars as S
from alphaloom.sources import tables as T


def one(df):
    return df.collect()[0]


def test_clean_and_suffix_ticker(spark):
    df = spark.createDataFrame([("2330.TW",), (" 00878b ",), ("fund.tw",), (None,)], "c string")
    rows = df.select(S.clean_ticker(F.col("c")), S.suffix_ticker(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("2330", "2330.TW"), ("00878", "00878.TW"), ("FUND", "FUND.TW"), (None, None)]


def test_numeric_and_date(spark):
    df = spark.createDataFrame([("1,234.5",), ("-",), ("N/A",), ("",), ("x",), (None,), ("NaN",)], "c string")
    assert [r[0] for r in df.select(S.numeric(F.col("c"))).collect()] == [1234.5, None, None, None, None, None, None]
    dates = spark.createDataFrame([("1994-09-05",), ("19620209",), ("soon",), (None,)], "c string")
    assert [r[0] for r in dates.select(S.to_date_lenient(F.col("c"))).collect()] == [dt.date(1994, 9, 5), dt.date(1962, 2, 9), None, None]


def test_numbers_that_a_cast_would_take(spark):
    texts = ["12d", "12f", "0x1p3", "1e3", "-.5", "+7.", "12 3", "1_000", ".", "e5", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r[0] for r in df.select(S.numeric(F.col("c"))).collect()] == [None, None, None, 1000.0, -0.5, 7.0, None, None, None, None, float("inf")]


def test_universe_in_english_and_chinese(spark):
    raw = spark.createDataFrame([("2330.TW", "Chip", "Semi", "", "1994-09-05")], "Code string, Name string, Industry string, Market string, ListedDate string")
    assert tuple(one(T.normalize_universe(raw))) == ("2330", "Chip", "Semi", "TWSE", dt.date(1994, 9, 5))
    raw = spark.createDataFrame([("1101", "Stone", "01", "19620209")], "`公司代號` string, `公司名稱` string, `產業別` string, `上市日期` string")
    assert tuple(one(T.normalize_universe(raw))) == ("1101", "Stone", "01", "TWSE", dt.date(1962, 2, 9))


def test_valuation_and_bars(spark):
    raw = spark.createDataFrame([("2024-01-02", "2330", "20.5", "-", "1.5")], "Date string, Code string, PEratio string, PBratio string, DividendYield string")
    assert tuple(one(T.normalize_valuation(raw))) == (dt.date(2024, 1, 2), "2330", 20.5, None, 1.5)
    raw = spark.createDataFrame([("2024-01-02", "2330", "1", "2", "0.5", "1.5", "1,000")], "Date string, Ticker string, Open string, High string, Low string, Close string, Volume string")
    assert tuple(one(T.normalize_ohlcv(raw))) == (dt.date(2024, 1, 2), "2330", 1.0, 2.0, 0.5, 1.5, 1000.0)


def test_format_bars_drops_what_is_unknown(spark):
    raw = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, 2.0, 9.9, 5)], "Datetime date, Open double, Close double, `Adj Close` double, Volume long")
    out = T.format_bars(raw, "2330")
    assert out.columns == ["date", "ticker", "open", "close", "volume"]


def test_failed_and_selected_tickers(spark):
    asked = spark.createDataFrame([("0001",), ("0002",), ("0003",), ("0002",), (None,)], "ticker string")
    came = spark.createDataFrame([("0001",), ("0003",)], "ticker string")
    assert [r[0] for r in T.failed_tickers(asked, came).collect()] == ["0002"]
    assert [r[0] for r in T.select_tickers(asked, 2).collect()] == ["0001", "0002"]
    assert T.select_tickers(asked, "all").count() == 3


def test_save_guard_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    path = T.save(df, str(tmp_path / "t"))
    assert T.load(spark, path).collect() == df.collect()
    with pytest.raises(ValueError, match="empty"):
        T.save(df.where("x > 5"), str(tmp_path / "e"))


def test_landed_json(spark, tmp_path):
    for name, payload in (("good", [{"Code": "1", "Name": "a"}]), ("object", {"Code": "1"}), ("empty", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(payload))
    assert T.read_landed_json(spark, str(tmp_path / "good")).count() == 1
    for name in ("object", "empty"):
        with pytest.raises(ValueError):
            T.read_landed_json(spark, str(tmp_path / name))


def test_manifest_and_upsert(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    old = T.manifest({"t": df.limit(1), "u": df}, "1", created_at="2023")
    new = T.manifest({"t": df}, "2", {"t": ["src"]}, created_at="2024")
    rows = {r["artifact_name"]: r for r in T.manifest_upsert(old, new).collect()}
    assert (rows["t"]["row_count"], rows["t"]["column_count"], rows["t"]["schema_version"], rows["t"]["source_inputs"]) == (2, 2, "2", ["src"])
    assert rows["u"]["schema_version"] == "1"


def test_stored_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "manifest")
    assert T.read_manifest(spark, path).count() == 0
    T.append_manifest(spark, path, T.manifest({"t": df, "u": df}, "1"))
    rows = {r["artifact_name"]: r for r in T.append_manifest(spark, path, T.manifest({"t": df.limit(1)}, "2", {"t": ["src"]})).collect()}
    assert (rows["t"]["row_count"], rows["t"]["schema_version"], rows["t"]["source_inputs"], rows["u"]["schema_version"]) == (1, "2", ["src"], "1")
    assert rows["u"]["created_at"][:2] == "20" and {r["artifact_name"] for r in T.read_manifest(spark, path).collect()} == {"t", "u"}
