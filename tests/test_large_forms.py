"""The forms for large panels give what the plain ones give: ranges, chunks, steps, intervals, blocks and splits, made tiny here."""

import datetime as dt
import json
import math
import random
import threading
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import scalars as S
from alphaloom.operators import backtest as B
from alphaloom.operators import factors as X
from alphaloom.operators import panel as P
from alphaloom.operators import portfolio as G
from alphaloom.operators import quality as Q
from alphaloom.operators import ranks as K
from alphaloom.plans import registry
from alphaloom.sources import json_arrays as J
from alphaloom.sources import tables as T
from alphaloom.sources.scratch import stored

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


# --- ranks by ranges


def _ranked(rows, descending):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((v for h, _, v in rows if h == g and v is not None), reverse=descending)
        for h, t, v in rows:
            if h == g:
                out[g, t] = (None, len(own)) if v is None else ((own.index(v) + 1 + len(own) - own[::-1].index(v)) / 2, len(own))
    return out


@pytest.mark.parametrize("tasks", [1, 3, 17])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_by_ranges(spark, tasks, descending):
    rng = random.Random(tasks)
    rows = [(g, f"t{k:03}", None if rng.random() < 0.1 else float(rng.choice([1, 2, 2, 2, 3, rng.random()]))) for g, n in ((None, 5), (1, 400), (2, 1), (3, 60)) for k in range(n)]
    rows += [(4, f"t{k}", None) for k in range(3)]
    df = spark.createDataFrame(rows, "g int, ticker string, v double")
    got = K.spread_ranks(df, ["g"], "v", descending, ["ticker"], tasks).collect()
    assert {(r["g"], r["ticker"]): (r["_average"], r["_count"]) for r in got} == _ranked(rows, descending) and len(got) == len(rows)
    for g in (None, 1, 2, 3):
        own = [(r["v"] * (-1 if descending else 1), r["ticker"], r["_position"]) for r in got if r["g"] == g and r["v"] is not None]
        assert [p for *_, p in sorted(own)] == list(range(1, len(own) + 1))
    assert K.spread_ranks(df.limit(0), ["g"], "v").count() == 0


def test_one_large_date_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(D0).alias("date"), F.col("id").cast("string").alias("ticker"), F.when(F.col("id") % 3 > 0, F.col("id") % 1000).otherwise(7).cast("double").alias("value"))
    plain = {r["ticker"]: r["rank"] for r in S.rank_factor(df, "value", spread=False).collect()}
    assert {r["ticker"]: r["rank"] for r in S.rank_factor(df, "value", spread=True).collect()} == pytest.approx(plain)
    # a third of the rows has one value, and no range is much larger than its share for that
    sizes = [r["n"] for r in df.repartitionByRange(8, "date", "value", F.xxhash64("ticker")).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20_000 / 8 * 2


def test_large_groups_are_spread(spark, monkeypatch):
    df = spark.createDataFrame([(D0, str(k), float(k)) for k in range(50)], "date date, ticker string, value double")
    assert not K.must_spread(df, ["date"])
    monkeypatch.setattr(K, "GROUP_ROWS", 49)
    assert not K.must_spread(df.withColumn("date", F.expr("date_add(date, cast(value as int))")), ["date"])
    assert K.must_spread(df, ["date"])
    composite = df.select("date", "ticker", F.col("value").alias("composite_score"), F.lit("historical_price_volume").alias("composite_type"), F.lit(False).alias("is_snapshot_component_used"))
    assert [r["ticker"] for r in G.ranked_scores(composite).orderBy("rank").collect()] == [str(k) for k in range(49, -1, -1)]


def _nodes(df, name):
    return sum(line.lstrip(" :+-*(0123456789)").startswith(name) for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines())


def test_ranks_deal_and_sort_a_group_once(spark):
    df = spark.createDataFrame([(k % 3, float(k), None if k % 5 else float(k % 2)) for k in range(60)], "date int, a double, b double").repartition(3)
    ranked = S.with_pct_ranks(df, ["date"], {"ra": ("a", S.HIGHER), "rb": ("b", S.LOWER)}, spread=False)
    assert (_nodes(ranked, "Sort"), _nodes(ranked, "Window"), _nodes(ranked, "Exchange hashpartitioning")) == (2, 2, 1)
    # as many tasks as shuffles have, however small
    assert ranked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_without_values_are_not_ranked(spark, monkeypatch):
    rows = [(day(k), f"t{j}", float(j % 3) if k == j % 4 else None, None, float(-j) if (k + j) % 5 == 0 else None) for k in range(4) for j in range(20)]
    pv = spark.createDataFrame(rows, "date date, ticker string, momentum_60d double, low_volatility_20d double, volume_ratio_5d_60d double")
    met = []
    ranked = X.with_pct_ranks
    monkeypatch.setattr(X, "with_pct_ranks", lambda df, *a: met.append(df.count()) or ranked(df, *a))
    got = {(r["date"], r["ticker"]): r["composite_score"] for r in X.historical_composite(pv).collect()}
    assert met == [sum(r[2] is not None or r[4] is not None for r in rows)] and len(got) == len(rows)
    for d, t, a, _, b in rows:
        top = low = 0.0
        for v, k, w in ((a, 2, 0.20), (b, 4, 0.15)):
            own = [r[k] for r in rows if r[0] == d and r[k] is not None]
            if v is not None:
                top, low = top + w * (sum(x < v for x in own) + (own.count(v) + 1) / 2) / len(own), low + w
        assert got[d, t] == (pytest.approx(top / low) if low else None)


def test_factors_at_bars_alone(spark):
    bars = spark.createDataFrame([(day(k), t, 2.0 + k, 1.0 + k, 1.5 + k, float(k + 1)) for k in range(70) for t in "abc" if t == "a" or k % 7], "date date, ticker string, high double, low double, close double, volume double")
    values = lambda df: {(r["date"], r["ticker"]): tuple(r)[2:] for r in df.collect()}
    every, own = values(X.price_volume_factors(bars)), values(X.price_volume_factors(bars, cells=False))
    assert len(every) == 210 and len(own) == bars.count() and {k: every[k] for k in own} == own
    assert all(v == (None, None, None) for k, v in every.items() if k not in own)
    # volatility from returns is known between bars, too
    closes = bars.drop("high", "low")
    assert values(X.price_volume_factors(closes, cells=False)) == values(X.price_volume_factors(closes))


def test_close_only_panels_share_a_shuffle_of_bars(spark):
    rng = random.Random(7)
    n = 95
    closes = {t: [None if rng.random() < gap else 0.0 if rng.random() < 0.03 else rng.uniform(50, 60) for _ in range(n)] for t, gap in (("a", 0.0), ("b", 0.6), ("c", 0.93))}
    volumes = {t: [None if c is None or (t == "a" and k == 4) else float(rng.randint(1, 9)) for k, c in enumerate(own)] for t, own in closes.items()}
    rows = [(day(k), t, c, volumes[t][k]) for t, own in closes.items() for k, c in enumerate(own) if c is not None]
    bars = stored(P.with_date_idx(spark.createDataFrame(rows, "date date, ticker string, close double, volume double")), "bars")
    none = F.lit(None).cast("double")
    both = X.price_volume_factors(bars).unionByName(X.price_volume_factors(bars.withColumns({"high": none, "low": none})))
    got = {}
    for r in both.collect():
        got.setdefault((r["date"], r["ticker"]), []).append(tuple(r)[2:])
    assert len(got) == 3 * n and all(len(v) == 2 and v[0] == v[1] for v in got.values())
    near = lambda v: None if v is None else pytest.approx(v)
    for t, own in closes.items():
        padded = [None] * n
        for k, c in enumerate(own):
            padded[k] = c if c is not None else padded[k - 1] if k else None
        for k in range(n):
            back = own[k - 60] if k >= 60 else None
            momentum = own[k] / back - 1 if own[k] is not None and back else None
            before = padded[k - 20 : k] if k >= 20 else [None]
            vol = None if None in before or 0.0 in before else stdev([b / a - 1 for a, b in zip(before, padded[k - 19 : k + 1])])
            long = volumes[t][k - 59 : k + 1] if k >= 59 else [None]
            ratio = None if own[k] is None or None in long else (sum(long[-5:]) / 5) / (sum(long) / 60)
            assert got[day(k), t][0] == (near(momentum), near(vol), near(ratio)), (t, k)
    # bars are shuffled, not the steps between them, and once for both panels
    both._jdf.collectToPython()
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("Generate inline") < plan.index("hashpartitioning(ticker")
    assert _nodes(both, "Exchange hashpartitioning(ticker") == 1 and _nodes(both, "ReusedExchange") >= 1


# --- folds and scans in pieces


@pytest.mark.parametrize("batch", [1, 2, 7])
def test_held_names_pass_from_batch_to_batch(spark, batch):
    rng = random.Random(batch)
    names = [f"t{k:02}" for k in range(9)]
    order = {d: rng.sample(names, rng.randint(1, 9)) for d in range(23)}
    grid = [("a", 3, 6), ("b", 4, 4), ("c", 2, 1)]
    rows = [(s, n, b, day(d), t, k + 1) for s, n, b in grid for d, own in order.items() for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, "scenario string, top_n int, drop_rank_buffer int, date date, ticker string, rank int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {}
        for r in G.topn_buffered(df).collect():
            got.setdefault((r["scenario"], r["date"]), set()).add(r["ticker"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for s, n, b in grid:
        held = set()
        for d, own in order.items():
            held = {t for t in own[:b] if t in held}
            held |= set([t for t in own[:n] if t not in held][: n - len(held)])
            assert got[s, day(d)] == held


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_equity_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(s, "c", 2, day(i), i + 1, 0.0, 0.0, 0.0, 0.0, "{}", 0.0, r) for s, loss in (("plain", 0.0), ("ruin", 0.15)) for i, r in enumerate([-1.5 if rng.random() < loss else rng.uniform(-0.3, 0.3) for _ in range(17)])]
    net = spark.createDataFrame(rows, "scenario string, cost string, top_n int, date date, date_idx int, gross double, buy double, sell double, exposure double, cost_model_summary string, cost_returns double, returns double")
    got = {(r["scenario"], r["date_idx"]): (r["equity"], r["drawdown"]) for r in B.equity_curve(net, 100.0, chunk).collect()}
    for s in ("plain", "ruin"):
        equity, peak = 100.0, -math.inf
        for r in (x for x in rows if x[0] == s):
            equity *= 1 + r[-1]
            peak = max(peak, equity)
            assert got[s, r[4]] == pytest.approx((equity, equity / peak - 1), rel=1e-9)


# --- volatility without a grid


def _grid_volatility(close, n, tickers, size, pad):
    out = {}
    for t in tickers:
        last, rets = None, []
        for i in range(size):
            now = close.get((i, t))
            c = (now if now is not None else last) if pad else now
            rets.append(c / last - 1 if c is not None and last else None)
            last = c
            own = rets[-n:]
            out[day(i), t] = stdev(own) if len(own) == n and None not in own else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_volatility_over_gaps(spark, seed):
    rng = random.Random(seed)
    size, tickers, n = 40, ["A", "B", "C", "D"], 4
    thin = dict(zip(tickers, (0.0, 0.3, 0.8, 0.95)))
    close = {(i, t): rng.choice([0.0, None, *(rng.uniform(50, 150) for _ in range(6))]) if seed else rng.uniform(50, 150) for i in range(size) for t in tickers if rng.random() >= thin[t]}
    close |= {(0, "A"): 1.0, (size - 1, "A"): 1.0, (5, "D"): 3.0}
    bars = spark.createDataFrame([(day(i), t, c) for (i, t), c in close.items()], "date date, ticker string, close double")
    dates = sorted({i for i, _ in close})
    at = {d: k for k, d in enumerate(dates)}
    for pad in (True, False):
        df = X.return_volatility(bars, n, "pad" if pad else "none")
        got = {(r["date"], r["ticker"]): r["return_volatility"] for r in df.collect()}
        want = _grid_volatility({(at[i], t): c for (i, t), c in close.items()}, n, tickers, len(dates), pad)
        want = {(day(dates[(d - D0).days]), t): v for (d, t), v in want.items()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_volatility_plan_has_no_grid(spark):
    bars = spark.createDataFrame([(day(i), t, 1.0 + i) for i in range(5) for t in "AB"], "date date, ticker string, close double")
    plan = X.return_volatility(bars, 3)._jdf.queryExecution().optimizedPlan().toString()
    crossed = [line for line in plan.splitlines() if "Join Cross" in line or line.strip(" :+-").rstrip() == "Join Inner"]
    # the one join without a key is that of the number of dates, one row
    assert len(crossed) <= 1 and "max(date_idx" in plan and "collect_list" not in plan


def test_factor_frame_with_gaps(spark):
    rng = random.Random(8)
    rows = [(day(i), t, 100.0, 100.0 + rng.random(), 99.0, 99.0 + rng.random(), float(rng.randint(1, 9))) for i in range(90) for t in "ABC" if t != "C" or rng.random() < 0.5]
    bars = spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")
    got = {(r["date"], r["ticker"]): r for r in X.price_volume_factors(bars).collect()}
    assert got.keys() == {(day(i), t) for i in range(90) for t in "ABC"}
    for name, f in (("momentum_60d", X.momentum(bars)), ("low_volatility_20d", X.atr_over_close(bars)), ("volume_ratio_5d_60d", X.volume_ratio(bars))):
        own = {(r[0], r[1]): r[2] for r in f.collect()}
        assert all(r[name] == own.get(k) for k, r in got.items())


# --- held weights


@pytest.mark.parametrize("span", [1, 3, 64])
def test_held_weights_as_intervals(spark, span, monkeypatch):
    monkeypatch.setattr(B, "SPAN", span)
    rng = random.Random(span)
    dates, tickers = list(range(30)), ["A", "B", "C", "D"]
    close = {(d, t): 100 * rng.uniform(0.8, 1.25) for d in dates for t in tickers if rng.random() > 0.15 or t == "A"}
    made = {s: {d: {t: rng.choice([0.25, 0.5]) for t in tickers if rng.random() > 0.4} for d in days} for s, days in (("s", [3, 4, 11, 25]), ("u", [0, 29]))}
    made = {s: {d: w or {"A": 0.5} for d, w in own.items()} for s, own in made.items()}
    bars = spark.createDataFrame([(day(d), t, c) for (d, t), c in close.items()], "date date, ticker string, close double")
    rows = [(s, day(d - 1), t, v, day(d)) for s, own in made.items() for d, w in own.items() for t, v in w.items()]
    weights = spark.createDataFrame(rows, "scenario string, date date, ticker string, target_weight double, execution_date date")
    grid = G.scenarios(spark, [("s", 2, "weekly", False, 30), ("u", 2, "weekly", False, 30)])
    got = {(r["scenario"], r["date"]): (r["gross"], r["buy"], r["sell"], r["exposure"]) for r in B.daily_sums(bars, weights, grid, "ffill").collect()}
    assert len(got) == 60
    for s, own in made.items():
        held, last = {}, {}
        for d in dates:
            ret = {t: close[d, t] / last[t] - 1 if t in last and (d, t) in close else 0.0 for t in tickers}
            last |= {t: close[d, t] for t in tickers if (d, t) in close}
            now = own.get(d, held)
            move = [now.get(t, 0) - held.get(t, 0) for t in tickers]
            want = (sum(held.get(t, 0) * ret[t] for t in tickers), sum(max(m, 0) for m in move), sum(max(-m, 0) for m in move), sum(now.values()))
            assert got[s, day(d)] == pytest.approx(want, abs=1e-12), (s, d)
            held = now
    per_date = {(r["scenario"], r["date_idx"], r["ticker"]) for r in B.aligned_weights(weights, bars, "ffill").collect()}
    assert ("s", 31, "A") not in per_date and {d for s, d, _ in per_date if s == "s"} == set(range(4, 31))


# --- blocks


@pytest.mark.parametrize("rows,columns", [(2, 3), (256, 256), (5, 1)])
def test_blocks_of_a_field(spark, rows, columns):
    rng = random.Random(rows)
    cells = {(day(i), f"t{k:02}"): rng.choice([None, rng.random()]) for i in range(7) for k in range(11) if rng.random() < 0.4 and not (i < 4 and k < 6)}
    cells |= {(day(i), "t00"): 1.5 for i in range(5, 7)} | {(day(i), "t10"): 2.5 for i in range(7)}
    bars = spark.createDataFrame([(d, t, v) for (d, t), v in cells.items()], "date date, ticker string, close double")
    blocks = P.field_blocks(bars, "close", rows, columns)
    names = sorted({t for _, t in cells})
    got = {(r["date"], r["asset"]): r["factor"] for r in blocks.to_long().collect()}
    assert got == {(day(i), t): cells.get((day(i), t)) for i in range(7) for t in names}
    assert blocks.to_long().count() == 7 * len(names)
    wide = P.unpivot_factor(P.field_matrix(bars, "close", names)).collect()
    assert got == {(r["date"], r["asset"]): r["factor"] for r in wide}
    assert blocks.blocks.count() == -(-7 // rows) * -(-len(names) // columns)


# --- landed arrays


def _records(rng, n):
    text = lambda: "".join(rng.choice(['a', '"', "\\", "}", "{", "]", "[", ",", "\n", "é", " "]) for _ in range(rng.randint(0, 25)))
    return [{"k": k, "s": text(), "in": {"t": text(), "l": [{"u": text()} for _ in range(rng.randint(0, 3))]}} for k in range(n)]


_RECORD = "k long, s string, `in` struct<t:string,l:array<struct<u:string>>>"


@pytest.mark.parametrize("split", ["128", "1000", "128m"])
def test_arrays_are_split_anywhere(spark, tmp_path, split):
    rng = random.Random(5)
    files = {"a.json": _records(rng, 120), "b.json": _records(rng, 1), "c.json": [], "d.json": _records(rng, 33)}
    for k, (name, rows) in enumerate(files.items()):
        body = json.dumps(rows, indent=None if k % 2 else 1, ensure_ascii=False)
        (tmp_path / name).write_text(("﻿ \n" if k == 3 else "") + body + " \n" * k, encoding="utf-8")
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0" if split != "128m" else "4m"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = sorted(json.dumps(r.asDict(True), sort_keys=True) for r in T.read_landed_json(spark, str(tmp_path), _RECORD).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(json.dumps(r, sort_keys=True) for rows in files.values() for r in rows)


def test_arrays_have_a_size(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 2001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), (F.col("id") / 4).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(registry, "ARRAY_ROWS", 300)
    monkeypatch.setattr(registry, "scratch", lambda _, name: f"{tmp_path}/{name}")
    got = registry.landed_array(registry.Case(spark, str(tmp_path))).collect()
    assert sorted(tuple(r) for r in got) == [(k, k % 7, k / 4, 'a "}" \\ ],{ of F') for k in range(1, 2001)]
    files = list((tmp_path / "array").rglob("part-*"))
    assert len(files) == 7 and max(len(json.loads(f.read_text())) for f in files) < 400


@pytest.mark.parametrize("payload", ['[{"a": 1}', '[{"a": 1}, ', '[{"a": 1}, {"a": 2', '{"a": 1}', "", "[1, 2]", '[{"a": "x}]', '[{"a": 1}] x', '[{"a": 1} {"a": 2}]', "[]", '[{"a": 1}, 5]', '[{"a": {"b": 1}]', '[{"a": 1},, {"a": 2}]'])
def test_broken_arrays(spark, tmp_path, payload):
    (tmp_path / "x.json").write_text(payload)
    with pytest.raises(Exception, match="Landed payload|Malformed|MALFORMED"):
        T.read_landed_json(spark, str(tmp_path), "a long").collect()


def test_state_of_splits():
    row = lambda start, odd, change, least, opens=False, closes=False: {"file": "f", "start": start, "odd": odd, "change": change, "least": least, "opens": opens, "closes": closes}
    begins = J._begins([row(0, True, [1, 0], [0, -1], True), row(9, True, [0, -2], [0, -2], closes=True)])
    assert begins == {("f", 0): (0, 0, 0, False), ("f", 9): (1, 1, 0, True)}


# --- manifest


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "manifest"), []
    base = T.manifest({"t": spark.range(3)}, "1", created_at="2024")

    def write(k):
        try:
            for i in range(3):
                T.append_manifest(spark, path, base.withColumn("artifact_name", F.lit(f"w{k}-{i}")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert {r["artifact_name"] for r in T.read_manifest(spark, path).collect()} == {f"w{k}-{i}" for k in range(3) for i in range(3)}
    assert sorted(p.name for p in (tmp_path / "manifest" / "versions").iterdir() if not p.name.startswith(".")) == [f"{k:08}" for k in range(1, 10)]
    # the number is taken: a late writer is told so
    assert not T._put_if_absent(spark, f"{path}/versions/00000009", "other")


def test_commit_through_a_mount(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounted.link./data", tmp_path.as_uri())
    path, base = "viewfs://mounted/data/manifest", T.manifest({"t": spark.range(3)}, "1", created_at="2024")
    for name in ("a", "b", "a"):
        T.append_manifest(spark, path, base.withColumn("artifact_name", F.lit(name)))
    assert sorted(r["artifact_name"] for r in T.read_manifest(spark, path).collect()) == ["a", "b"]
    # one of many writers has the next number, and the file is its own
    got = []
    writers = [threading.Thread(target=lambda k=k: got.append((T._put_if_absent(spark, f"{path}/versions/00000004", f"w{k}"), f"w{k}"))) for k in range(12)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert [name for won, name in got if won] == [(tmp_path / "manifest" / "versions" / "00000004").read_text()] and len(got) == 12


# --- dates

FORMS = {
    "2024-01-05": (5, 1), "20240105": (5, 1), "2024/01/05": (5, 1), "2024/1/5": (5, 1), "2024.01.05": (5, 1), "1/5/2024": (5, 1), "01-05-2024": (5, 1), "1/5/24": (5, 1), "Jan 5, 2024": (5, 1), "January 5 2024": (5, 1), "5 Jan 2024": (5, 1),
    "05-Mar-2024": (5, 3), "Fri, 5 Jan 2024": (5, 1), "2024-01-05T10:11:12": (5, 1), "1/5/2024 10:11": (5, 1), "dec. 31, 2024": (31, 12), "13/1/2024": None, "2024/13/01": None, "Feb 30, 2024": None, "soon": None, "": None, "Jany 5, 2024": None, "2024/01/05 x": None, "5": None,
}


def test_date_forms(spark):
    df = spark.createDataFrame([(k,) for k in FORMS], "raw string").withColumn("date", S.to_date_lenient(F.col("raw")))
    want = {k: None if v is None else dt.date(2024, v[1], v[0]) for k, v in FORMS.items()}
    assert {r["raw"]: r["date"] for r in df.collect()} == want


def test_a_form_is_looked_for_once(spark):
    df = spark.createDataFrame([(k,) for k in FORMS], "raw string").withColumn("date", S.to_date_lenient(F.col("raw")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # one look a form (years have three), and no parser of a pattern for texts that are not all digits
    assert plan.count("RLIKE") == 7 and plan.count("regexp_extract") <= 6
    ends = spark.createDataFrame([(f"2024/1/5{e}",) for e in ("", "\n", " \r\n", "\u0085", "\u2028", "x")], "raw string")
    assert [r[0] for r in ends.select(S.to_date_lenient(F.col("raw"))).collect()] == [dt.date(2024, 1, 5)] * 5 + [None]


def test_a_number_is_looked_for_once(spark):
    texts = [*S.MISSING_NUMBERS, " - ", "NaN", "-nan", " 1,2e3 ", "-Infinity", "1e999"]
    df = spark.createDataFrame([(x,) for x in texts], "raw string").select(S.numeric(F.col("raw")).alias("value"))
    assert [r[0] for r in df.collect()] == [None] * (len(texts) - 3) + [12_000.0, float("-inf"), float("inf")]
    # twice the text: to look at, and to read
    assert df._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 2


def test_a_column_votes_for_its_order(spark):
    def dates(*raw):
        df = spark.createDataFrame([(x, "1") for x in raw], "Date string, Code string")
        return {r["date"] for r in T.normalize_ohlcv(df).collect()}

    d = lambda m, k: dt.date(2024, m, k)
    assert dates("1/5/2024", "2/6/2024") == {d(1, 5), d(2, 6)}
    assert dates("1/5/2024", "13/6/2024") == {d(5, 1), d(6, 13)}
    assert dates("1/5/2024", "6/13/2024") == {d(1, 5), d(6, 13)}
    assert dates("1/5/2024", "6/13/2024", "6/14/2024", "15/6/2024") == {d(1, 5), d(6, 13), d(6, 14), None}
    assert dates() == set()


# --- what values have read


def test_latest_reads_catch_a_leak(spark):
    bars = spark.createDataFrame([(day(i), t, 100.0 + (i * 7 + k * 3) % 11) for i in range(30) for k, t in enumerate("AB") if (i, t) != (12, "B")], "date date, ticker string, close double")
    cuts = spark.createDataFrame([(day(i),) for i in range(30)], "cut date")
    fine = Q.latest_reads(bars, lambda b: X.momentum(b, 3), "momentum", cuts).collect()
    assert len(fine) == 59 and all(r["latest_read"] == r["date"] and not r["leaks"] for r in fine)
    leaky = {(r["date"], r["ticker"]): r for r in Q.latest_reads(bars, lambda b: X.momentum(b, -3), "momentum", cuts).collect()}
    for i in range(30):
        r = leaky[day(i), "A"]
        assert r["latest_read"] == day(i + 3 if i < 27 else i) and r["leaks"] == (i < 27)
    assert not leaky[day(9), "B"]["leaks"]  # the bar that it would read is not there
    checks = {r["cut"]: r for r in Q.lookahead_checks(bars, lambda b: X.return_volatility(b, 4), "return_volatility", cuts.where("day(cut) % 9 = 0"), 4).collect()}
    assert set(checks) == {day(8), day(17), day(26)} and all(r["is_backward_looking"] and r["rows"] == 2 * ((r["cut"] - D0).days + 1) for r in checks.values())
    leaks = Q.lookahead_checks(bars, lambda b: X.momentum(b, -3), "momentum", cuts, 3).where("not is_backward_looking").count()
    assert leaks == 29
