"""Panel, factors, ranks and factor analysis on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import scalars as S
from alphaloom.operators import analysis as A
from alphaloom.operators import factors as X
from alphaloom.operators import panel as P
from alphaloom.operators import quality as Q
from alphaloom.operators import scoreboard as R

D0 = dt.date(2024, 1, 1)
BARS = "date date, ticker string, open double, high double, low double, close double, volume double"


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(spark, n, f, tickers=("A",)):
    return spark.createDataFrame([(day(i), t, *f(i, t)) for i in range(n) for t in tickers], BARS)


def values(df, c):
    return {(r["date"], r["ticker"]): r[c] for r in df.collect()}


def test_duplicates_and_missing_columns(spark):
    df = spark.createDataFrame([(D0, "A", 1.0), (D0, "A", 2.0), (D0, "B", 1.0)], "date date, ticker string, close double")
    assert [tuple(r) for r in P.duplicate_keys(df).collect()] == [(D0, "A", 2)]
    with pytest.raises(ValueError, match="duplicate"):
        P.validate_panel(df, ["close"])
    with pytest.raises(KeyError, match="high.*low"):
        P.validate_panel(df, ["low", "high"])


def test_grid_and_pivot(spark):
    df = spark.createDataFrame([(D0, "A", 1.0), (day(1), "A", 2.0), (day(1), "B", 3.0)], "date date, ticker string, close double")
    grid = {(r["date_idx"], r["ticker"]): r["close"] for r in P.dense_grid(df).collect()}
    assert grid == {(1, "A"): 1.0, (1, "B"): None, (2, "A"): 2.0, (2, "B"): 3.0}
    wide = P.field_matrix(df, "close", ["A", "B"])
    assert [tuple(r) for r in wide.collect()] == [(D0, 1.0, None), (day(1), 2.0, 3.0)]
    assert P.unpivot_factor(wide).count() == 4


def test_momentum_65_rows(spark):
    df = bars(spark, 65, lambda i, t: (1.0, 1.0, 1.0, i + 1.0, 100.0))
    out = values(X.momentum(df), "momentum")
    assert out[day(64), "A"] == pytest.approx(65 / 5 - 1) and out[day(59), "A"] is None


def test_momentum_over_a_gap_uses_positions(spark):
    df = bars(spark, 65, lambda i, t: (1.0, 1.0, 1.0, i + 1.0, 100.0), ("A", "B")).where("not (ticker = 'A' and date = date'2024-01-05')")
    out = values(X.momentum(df), "momentum")
    assert out[day(64), "A"] is None and out[day(64), "B"] == pytest.approx(12)


def test_atr_and_method(spark):
    df = bars(spark, 25, lambda i, t: (100.0, 105.0, 95.0, 100.0, 1.0))
    out = values(X.atr_over_close(df), "atr_over_close")
    assert out[day(24), "A"] == pytest.approx(0.1) and out[day(19), "A"] is None and out[day(20), "A"] is not None
    assert X.low_volatility_method(df).first()[0] == "atr_20d_over_close"
    assert X.low_volatility_method(df.withColumn("high", F.lit(None).cast("double"))).first()[0] == "return_volatility_20d"


def test_return_volatility_pads_gaps(spark):
    df = bars(spark, 30, lambda i, t: (1.0, 1.0, 1.0, 100.0 + i % 2, 1.0), ("A", "B")).where("not (ticker = 'A' and date = date'2024-01-11')")
    pad, none = values(X.return_volatility(df), "return_volatility"), values(X.return_volatility(df, fill="none"), "return_volatility")
    assert pad[day(25), "A"] is not None and none[day(25), "A"] is None and pad[day(25), "B"] == pytest.approx(none[day(25), "B"])


def test_warm_up_counts(spark):
    df = bars(spark, 70, lambda i, t: (100.0, 105.0, 95.0, 100.0 + i, 10.0))
    row = X.price_volume_factors(df).agg(F.count("momentum_60d"), F.count("low_volatility_20d"), F.count("volume_ratio_5d_60d")).first()
    assert tuple(row) == (10, 50, 11)


def test_rank_ties_nulls_and_direction(spark):
    df = spark.createDataFrame([(D0, t, v) for t, v in zip("ABCD", (1.0, 2.0, 2.0, None))], "date date, ticker string, value double")
    up = {r["ticker"]: r["rank"] for r in S.rank_factor(df, "value").collect()}
    assert up == {"A": pytest.approx(1 / 3), "B": pytest.approx(2.5 / 3), "C": pytest.approx(2.5 / 3), "D": None}
    down = {r["ticker"]: r["rank"] for r in S.rank_factor(df, "value", direction=S.LOWER).collect()}
    assert down["A"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="direction"):
        S.rank_factor(df, "value", direction="sideways")


def test_valuation_factors(spark):
    v = spark.createDataFrame([(None, "A", 0.0, -1.0, 3.0), (None, "B", 10.0, 2.0, None)], "date date, ticker string, pe double, pb double, dividend_yield double")
    rows = {r["ticker"]: r for r in X.valuation_factors(v, "2024-05-01").collect()}
    assert rows["A"]["pb_inverse"] is None and rows["A"]["pe_inverse"] is None and rows["B"]["pb_inverse"] == 0.5
    assert rows["A"]["as_of_date"] == dt.date(2024, 5, 1) and rows["A"]["is_snapshot"]


def test_composites(spark):
    pv = spark.createDataFrame([(D0, "A", 1.0, 0.1, None), (D0, "B", 2.0, 0.2, None), (day(1), "A", None, None, None)], "date date, ticker string, momentum_60d double, low_volatility_20d double, volume_ratio_5d_60d double")
    rows = values(X.historical_composite(pv), "composite_score")
    assert rows[D0, "A"] == pytest.approx((0.2 * 0.5 + 0.15 * 1.0) / 0.35) and rows[day(1), "A"] is None
    with pytest.raises(ValueError):
        X.weighted_rank(pv, {})
    v = spark.createDataFrame([(None, "A", 10.0, 2.0, 1.0)], "date date, ticker string, pe double, pb double, dividend_yield double")
    mixed = X.mixed_composite(pv, X.valuation_factors(v, "2024-05-01")).collect()
    assert [(r["date"], r["composite_score"], r["is_snapshot_component_used"]) for r in mixed] == [(dt.date(2024, 5, 1), pytest.approx(1.0), True)]


def test_forward_returns(spark):
    df = spark.createDataFrame([(day(i), t, 100.0 * 1.1**i) for i in range(3) for t in "AB"], "date date, ticker string, close double")
    rows = A.forward_returns(df, [1]).collect()
    assert len(rows) == 4 and all(r["forward_return"] == pytest.approx(0.1) for r in rows)


def small(spark, rows, name="value"):
    return spark.createDataFrame(rows, f"factor string, date date, ticker string, {name} double")


def fwd(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker string, forward_return double, horizon int")


def test_ic_and_summary(spark):
    f = small(spark, [("f", day(d), t, float(i)) for d in range(2) for i, t in enumerate("ABC")])
    w = fwd(spark, [(day(d), t, i / 10, 1) for d in range(2) for i, t in enumerate("ABC")])
    assert sorted(r["ic"] for r in A.rank_ic(f, w).collect()) == pytest.approx([1.0, 1.0])
    row = A.ic_summary(A.rank_ic(f, w)).first()
    assert row["ic_std"] == 0 and row["ir"] is None and row["valid_date_count"] == 2
    assert A.rank_ic(f.withColumn("value", F.lit(1.0)), w).count() == 0


def test_quantiles_lower_is_better(spark):
    f = small(spark, [("low_volatility_20d", D0, t, i / 10) for i, t in enumerate("ABCDE", 1)])
    w = fwd(spark, [(D0, t, i / 10, 1) for t, i in zip("ABCDE", (5, 4, 3, 2, 1))])
    q = A.factor_quantiles(f)
    means = {r["quantile"]: r["mean_return"] for r in A.quantile_returns(q, w).collect()}
    assert means[5] == pytest.approx(0.5) and means[1] == pytest.approx(0.1)
    assert A.quantile_pivot(A.quantile_returns(q, w)).first()["top_bottom_spread"] == pytest.approx(0.4)


def test_seven_values_are_cut_as_documented(spark):
    f = small(spark, [("momentum_60d", D0, t, float(i)) for i, t in enumerate("ABCDEFG")])
    assert [r["quantile"] for r in A.factor_quantiles(f).orderBy("ticker").collect()] == [1, 1, 2, 3, 3, 4, 5]


def test_turnover_and_monotonicity(spark):
    rows = [("momentum_60d", day(d), t, float(i if d == 0 else -i)) for d in range(2) for i, t in enumerate("ABCDE")]
    q = A.factor_quantiles(small(spark, rows))
    row = A.bucket_turnover(q).first()
    assert (row["best_quantile"], row["average_best_bucket_turnover"], row["date_count"]) == (5, 1.0, 2)
    qr = spark.createDataFrame([("f", 1, k, k / 10) for k in range(1, 6)] + [("g", 1, 1, 0.5)], "factor string, horizon int, quantile int, mean_return double")
    out = {r["factor"]: r for r in A.monotonicity(qr).collect()}
    assert out["f"]["monotonicity_pass"] and out["f"]["adjacent_agreement_ratio"] == 1.0
    assert not out["g"]["monotonicity_pass"] and out["g"]["notes"] == "insufficient quantile buckets" and out["g"]["top_bottom_spread"] is None


def test_scoreboard(spark):
    ic = spark.createDataFrame([("momentum_60d", 1, 0.1, 0.2, 0.5), ("momentum_60d", 5, 0.1, 0.2, 0.9), ("pb_inverse", 1, 0.5, 0.1, 5.0)], "factor string, horizon int, ic_mean double, ic_std double, ir double")
    qr = spark.createDataFrame([("momentum_60d", 5, 1, 0.1), ("momentum_60d", 5, 5, 0.4)], "factor string, horizon int, quantile int, mean_return double")
    turnover = spark.createDataFrame([("momentum_60d", 0.3)], "factor string, average_best_bucket_turnover double")
    mono = spark.createDataFrame([("momentum_60d", 5, 0.5, False)], "factor string, horizon int, adjacent_agreement_ratio double, monotonicity_pass boolean")
    board = R.factor_scoreboard(ic, qr, turnover, mono, 3)
    rows = {r["factor"]: r for r in board.collect()}
    m = rows["momentum_60d"]
    assert (m["best_horizon"], m["is_backtest_candidate"], m["notes"]) == (5, True, "weak monotonicity warning; limited OHLCV coverage: 3 tickers")
    assert m["top_bottom_spread"] == pytest.approx(0.3) and not rows["pb_inverse"]["is_backtest_candidate"] and len(rows) == 5
    assert R.require_factor(board, "momentum_60d") == "momentum_60d"
    with pytest.raises(ValueError):
        R.require_factor(board, "pb_inverse")
    with pytest.raises(ValueError):
        R.require_not_snapshot("latest_snapshot_mixed")


def test_quality_tables(spark):
    df = spark.createDataFrame([(D0, "A", 1.0), (day(1), "B", None)], "date date, ticker string, value double")
    assert {tuple(r) for r in Q.missing_ratio_columns(df).collect()} == {("date", 0.0), ("ticker", 0.0), ("value", 0.5)}
    assert Q.missing_ratio_columns(df.limit(0)).count() == 0 and Q.missing_ratio_overall(df.limit(0)).first()[0] == 0.0
    assert Q.missing_ratio_overall(df).first()[0] == pytest.approx(0.5 / 3)
    assert Q.date_range(df).first()[0] == "2024-01-01 to 2024-01-02" and Q.date_range(df.limit(0)).first()[0] == "N/A"
    assert Q.factor_alignment(df, df).first()["is_aligned"] and Q.factor_readiness(df, df).first()["is_ready"]
    off = df.withColumn("date", F.date_add("date", 1))
    assert not Q.factor_alignment(off, df).first()["is_aligned"] and not Q.factor_readiness(df.limit(0), df).first()["is_ready"]
    assert Q.snapshot_limitation(df.withColumn("date", F.lit(None).cast("date"))).first()[0].startswith("valuation inputs are latest")


def test_lookahead_is_caught(spark):
    df = bars(spark, 12, lambda i, t: (1.0, 1.0, 1.0, 1.0 + i, 1.0))
    good = Q.lookahead_check(df, lambda b: X.momentum(b, 3), "momentum", F.lit(day(8)), 3).first()
    assert good["changed"] == 0 and good["is_backward_looking"]
    bad = Q.lookahead_check(df, lambda b: A.forward_returns(b, [1]), "forward_return", F.lit(day(8)), 1).first()
    assert bad["changed"] == 1 and not bad["is_backward_looking"]
