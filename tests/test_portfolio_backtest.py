"""Selection, calendars, weights and the backtest, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import backtest as B
from alphaloom.operators import panel as P
from alphaloom.operators import portfolio as G
from alphaloom.operators import scoreboard as R

D0 = dt.date(2024, 1, 1)  # a Monday
COMPOSITE = "date date, ticker string, composite_score double, composite_type string, is_snapshot_component_used boolean"


def day(i):
    return D0 + dt.timedelta(days=i)


def composite(spark, rows):
    return spark.createDataFrame([(d, t, s, "historical_price_volume", False) for d, t, s in rows], COMPOSITE)


def closes(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker string, close double")


def held(df):
    out = {}
    for r in df.where("selected").collect():
        out.setdefault(r["date"], set()).add(r["ticker"])
    return out


def test_topn_ties_and_nulls(spark):
    c = composite(spark, [(D0, "0001", 0.1), (D0, "0002", 0.9), (D0, "0003", 0.9), (D0, "0004", None)])
    pos = G.topn_positions(c, G.scenarios(spark, [("s", 2, "daily", False, 30)]))
    assert held(pos) == {D0: {"0002", "0003"}} and pos.count() == 3
    snapshot = c.withColumn("is_snapshot_component_used", F.lit(True))
    assert R.selected_factor_scores(snapshot).count() == 0


def test_buffer_keeps_and_drops(spark):
    order = {0: "ABCDEF", 1: "CDEBFA", 2: "CDEFGB"}
    c = composite(spark, [(day(d), t, -float(k)) for d, s in order.items() for k, t in enumerate(s)])
    got = held(G.topn_positions(c, G.scenarios(spark, [("s", 2, "daily", True, 4)])))
    # B stays at rank 4, A goes from rank 6, and B goes at rank 6
    assert got == {day(0): {"A", "B"}, day(1): {"B", "C"}, day(2): {"C", "D"}}


def test_buffer_against_brute_force(spark):
    rng = random.Random(7)
    rows, grid = [], [("a", 3, "daily", True, 6), ("b", 5, "daily", True, 5), ("c", 4, "daily", True, 2)]
    tickers = [f"t{k:02}" for k in range(12)]
    table = {d: rng.sample(tickers, rng.randint(2, 12)) for d in range(25)}
    for d, names in table.items():
        rows += [(day(d), t, -float(k)) for k, t in enumerate(names)]
    pos = G.topn_positions(composite(spark, rows), G.scenarios(spark, grid))
    for name, n, _, _, buffer in grid:
        now: set = set()
        want = {}
        for d in sorted(table):
            names = table[d]
            keep = [t for t in names[:buffer] if t in now][:n]
            keep += [t for t in names[:n] if t not in keep][: n - len(keep)]
            now = set(keep)
            want[day(d)] = now
        assert held(pos.where(F.col("scenario") == name)) == want


def test_calendars(spark):
    days = [day(i) for i in range(100) if day(i).weekday() < 5]
    bars = closes(spark, [(d, "A", 1.0) for d in days])
    daily, weekly, monthly = (G.rebalance_calendar(bars, f).collect() for f in G.FREQUENCIES)
    assert len(daily) == len(days) - 1 and len(weekly) > len(monthly) > 2
    assert len({r["signal_date"].isocalendar()[:2] for r in weekly}) == len(weekly)
    assert all(r["execution_date"] == days[days.index(r["signal_date"]) + 1] for r in daily)
    for bad in (("hourly", 1), ("daily", 0)):
        with pytest.raises(ValueError):
            G.rebalance_calendar(bars, *bad)


def test_weights(spark):
    c = composite(spark, [(day(4), t, s) for t, s in (("A", 1.0), ("B", 2.0))])
    pos = G.topn_positions(c, G.scenarios(spark, [("s", 2, "daily", False, 30)]))
    w = G.equal_weights(pos).collect()
    assert sum(r["target_weight"] for r in w) == 1.0 and {r["execution_date"] for r in w} == {day(5)}
    bars = closes(spark, [(d, "A", 1.0) for d in (day(4), day(7))])
    assert {r["execution_date"] for r in G.equal_weights(pos, 1, "trading_day", bars).collect()} == {day(7)}


def test_costs(spark):
    m = B.CostModel()
    assert m.buy_cost_rate == pytest.approx(0.002425) and m.sell_cost_rate == pytest.approx(0.005425)
    assert B.cost_scenarios_df(spark, [m]).first()["cost_model_summary"].startswith('{"buy_cost_rate"')


def _brute(close, weights, dates, tickers, m):
    """Plain loops over a dense matrix."""
    w = [{t: weights.get((d, t), 0.0) for t in tickers} for d in dates]
    last, out, equity, peak = {}, [], 1e6, 0.0
    for i, d in enumerate(dates):
        ret = {t: (close[d, t] / last[t] - 1 if (d, t) in close and t in last else 0.0) for t in tickers}
        last.update({t: close[d, t] for t in tickers if (d, t) in close})
        before = w[i - 1] if i else dict.fromkeys(tickers, 0.0)
        gross = sum(before[t] * ret[t] for t in tickers)
        buy, sell = (sum(max(s * (w[i][t] - before[t]), 0) for t in tickers) for s in (1, -1))
        net = gross - buy * m.buy_cost_rate - sell * m.sell_cost_rate
        equity *= 1 + net
        peak = max(peak, equity)
        out.append((d, equity, net, equity / peak - 1, buy + sell, sum(w[i].values())))
    return out


def test_engine_against_brute_force(spark):
    rng = random.Random(3)
    dates, tickers = [day(i) for i in range(30)], ["A", "B", "C", "D"]
    close = {(d, t): 100 * rng.uniform(0.8, 1.25) for d in dates for t in tickers if rng.random() > 0.15}
    weights = {(d, t): rng.choice([0.25, 0.5]) for d in dates for t in tickers if rng.random() > 0.5}
    bars = closes(spark, [(d, t, c) for (d, t), c in close.items()])
    # the last signal for an execution date wins; other dates and tickers do not count
    rows = [("s", d - dt.timedelta(days=1), t, v, d) for (d, t), v in weights.items()] + [("s", d - dt.timedelta(days=3), t, 9.0, d) for d, t in weights] + [("s", D0, "Z", 1.0, day(3)), ("s", D0, "A", 1.0, day(99))]
    w = spark.createDataFrame(rows, "scenario string, date date, ticker string, target_weight double, execution_date date")
    grid, costs = G.scenarios(spark, [("s", 2, "daily", False, 30)]), B.cost_scenarios_df(spark, [B.CostModel()])
    results, metrics = B.backtest(bars, w, grid, costs)
    want = _brute(close, weights, dates, tickers, B.CostModel())
    got = results.orderBy("date").select("date", "equity", "returns", "drawdown", "turnover", "exposure").collect()
    assert len(got) == 30
    for a, b in zip(got, want):
        assert a[0] == b[0] and list(a)[1:] == pytest.approx(list(b)[1:], abs=1e-9, rel=1e-9)
    m = metrics.first()
    assert m["total_return"] == pytest.approx(want[-1][1] / want[0][1] - 1) and m["ticker_count"] == 4
    assert m["max_drawdown"] == pytest.approx(min(x[3] for x in want)) and m["win_rate"] == pytest.approx(sum(x[2] > 0 for x in want) / 30)


def test_held_weights(spark):
    bars = closes(spark, [(day(i), "A", 1.0) for i in range(5)])
    w = spark.createDataFrame([("s", day(0), "A", 1.0, day(1))], "scenario string, date date, ticker string, target_weight double, execution_date date")
    assert [r["date_idx"] for r in B.aligned_weights(w, bars).collect()] == [2]
    assert sorted(r["date_idx"] for r in B.aligned_weights(w, bars, "ffill").collect()) == [2, 3, 4, 5]


def _walk(spark, n_days=60, n=8):
    rng = random.Random(11)
    days = [day(i) for i in range(n_days * 2) if day(i).weekday() < 5][:n_days]
    price = dict.fromkeys([f"t{k}" for k in range(n)], 100.0)
    bars, comp = [], []
    for d in days:
        for t in price:
            price[t] *= 1 + rng.gauss(0, 0.01)
            bars.append((d, t, price[t]))
            comp.append((d, t, rng.random()))
    return closes(spark, bars), composite(spark, comp)


def test_sensitivity_grids(spark):
    bars, comp = _walk(spark)
    models = [B.CostModel("no_cost", 0, 0, 0, 0), B.CostModel()]
    cost = {r["scenario"]: r for r in B.cost_scenarios(bars, comp, models, 3).collect()}
    assert cost["no_cost"]["total_return"] >= cost["base_cost"]["total_return"] and cost["no_cost"]["cost_drag"] == 0
    assert cost["base_cost"]["cost_drag"] == pytest.approx(cost["no_cost"]["total_return"] - cost["base_cost"]["total_return"])
    top = {r["top_n"]: r for r in B.topn_sensitivity(bars, comp, [2, 20]).collect()}
    assert top[20]["notes"] == "universe_size=8 < top_n=20" and top[2]["notes"] == ""
    freq = {r["rebalance_frequency"]: r for r in B.rebalance_sensitivity(bars, comp, top_n=3).collect()}
    assert freq["daily"]["rebalance_count"] > freq["weekly"]["rebalance_count"] > freq["monthly"]["rebalance_count"] > 0


def test_turnover_diagnostics(spark):
    shape = "scenario string, date date, ticker string, target_weight double, execution_date date"
    w = spark.createDataFrame([("s", day(i), t, 0.2, day(i + 1)) for i in range(50) for t in "ABCDE"], shape)
    rows = {r["metric"]: r["value"] for r in B.turnover_diagnostics(w, B.CostModel("free", 0, 0, 0, 0)).collect()}
    assert rows["avg_holdings"] == 5 and rows["estimated_cost_drag"] == 0 and rows["max_daily_turnover"] == pytest.approx(1.0)
    assert rows["annualized_turnover_estimate"] == pytest.approx(252 * rows["average_daily_turnover"])
    assert B.turnover_diagnostics(w.limit(0)).count() == 0


def test_readiness_gate(spark):
    bars = closes(spark, [(D0, "A", 1.0)])
    with pytest.raises(RuntimeError):
        R.require_ready(bars, 2)
    R.require_ready(bars, 1)


def test_near_ranks_select_the_same(spark):
    rng = random.Random(11)
    rows = [(day(d), f"t{k:02}", float(rng.randint(0, 9))) for d in range(15) for k in range(12)]
    c, grid = composite(spark, rows), G.scenarios(spark, [("plain", 3, "daily", False, 30), ("kept", 3, "weekly", True, 6), ("low", 4, "daily", True, 2)])
    every, near = G.topn_positions(c, grid), G.topn_positions(c, grid, near_only=True)

    def picked(df):
        return sorted((r["scenario"], r["date"], r["ticker"]) for r in df.where("selected").collect())

    assert picked(near) == picked(every) and near.count() == 15 * (3 + 6 + 4) and every.count() == 15 * 12 * 3


def test_stored_positions_change_nothing(spark):
    rng = random.Random(5)
    days = [day(d) for d in range(0, 75, 2)]
    bars = closes(spark, [(d, t, 50 + rng.random()) for d in days for t in "ABCD" if rng.random() < 0.9] + [(None, "A", 1.0)])
    c = composite(spark, [(d, t, rng.random()) for d in days for t in "ABCD"]).cache()
    stored = P.with_date_idx(bars).cache()
    grid = G.scenarios(spark, [(f, 2, f, False, 30) for f in G.FREQUENCIES])

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rows(G.calendars(bars)) == rows(G.calendars(stored))
    for f in G.FREQUENCIES:
        assert rows(G.rebalance_calendar(bars, f)) == rows(G.calendars(stored).where(F.col("rebalance_frequency") == f))
    assert rows(B.asset_returns(bars)) == rows(B.asset_returns(stored))
    assert rows(P.dense_grid(bars.where("date is not null"))) == rows(P.dense_grid(stored).select("date", "ticker", "date_idx", "close"))
    weights = G.equal_weights(G.topn_positions(c, grid, G.calendars(bars)), 1, "trading_day", bars)
    plain, kept = (B.daily_sums(b, weights, grid).select("scenario", "date_idx", "gross", "buy", "sell", "exposure") for b in (bars, stored))
    assert rows(plain) == rows(kept)
    # the sums of one pass are those of the separate operators
    aligned = B.aligned_weights(weights, bars)
    gross = {tuple(r)[:2]: r["gross"] for r in B.gross_returns(aligned, B.asset_returns(bars)).collect()}
    moved = {tuple(r)[:2]: (r["buy"], r["sell"]) for r in B.turnover_daily(aligned).collect()}
    for r in plain.collect():
        key = (r["scenario"], r["date_idx"])
        assert r["gross"] == pytest.approx(gross.get(key, 0.0)) and (r["buy"], r["sell"]) == pytest.approx(moved.get(key, (0.0, 0.0)))
