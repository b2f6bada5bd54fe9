"""DuckDB statements for the registered queries, written matrix-style: dense grids, row shifts and self-joins.

``PARTS`` are named subqueries; a statement gets those it refers to, directly or not.
"""

from __future__ import annotations

import re

LEVEL = "100000"
AS_OF, CUT = "DATE '1998-12-31'", "DATE '1996-06-30'"


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def _bars(ticker: str, date: str, where: str = "true", parts: str = "JOIN part ON l_partkey = p_partkey") -> str:
    return f"""
      SELECT date, ticker, {r("(high + low) / 2", 4)} AS open, high, low, {r(f"c / q / 100 + {LEVEL}", 4)} AS close, CAST(q AS DOUBLE) AS volume
      FROM (SELECT {date} AS date, ticker, max(c / q / 100 + {LEVEL}) AS high, min(c / q / 100 + {LEVEL}) AS low, sum(c)::BIGINT AS c, sum(q)::BIGINT AS q
            FROM (SELECT CAST(l_shipdate AS DATE) AS day, {ticker} AS ticker, CAST(round(l_quantity) AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c
                  FROM lineitem {parts}) WHERE {where} GROUP BY 1, 2)"""


def _grid(bars: str) -> str:
    return f"""
      SELECT d.date, d.date_idx, t.ticker, b.open, b.high, b.low, b.close, b.volume, b.ticker IS NOT NULL AS here
      FROM (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS date_idx FROM (SELECT DISTINCT date FROM {bars})) d
      CROSS JOIN (SELECT DISTINCT ticker FROM {bars}) t LEFT JOIN {bars} b ON b.date = d.date AND b.ticker = t.ticker"""


_T = "PARTITION BY ticker ORDER BY date_idx"


def _full(agg: str, column: str, n: int) -> str:
    frame = f"OVER ({_T} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({column}) {frame} = {n} THEN {agg}({column}) {frame} END"


def _factors(grid: str) -> str:
    return f"""
      SELECT date, date_idx, ticker, here, close / lag(close, 60) OVER ({_T}) - 1 AS momentum_60d,
             ({_full("avg", "tr", 20)}) / close AS low_volatility_20d, ({_full("avg", "volume", 5)}) / ({_full("avg", "volume", 60)}) AS volume_ratio_5d_60d
      FROM (SELECT *, CASE WHEN high IS NOT NULL AND low IS NOT NULL AND lag(close) OVER ({_T}) IS NOT NULL
                      THEN greatest(high - low, abs(high - lag(close) OVER ({_T})), abs(low - lag(close) OVER ({_T}))) END AS tr FROM {grid})"""


def _rank(f: str, lower: bool = False) -> str:
    better = ">" if lower else "<"
    return f"CASE WHEN any_value(a.{f}) IS NOT NULL THEN (count(*) FILTER (WHERE b.{f} {better} a.{f}) + (count(*) FILTER (WHERE b.{f} = a.{f}) + 1) / 2.0) / count(b.{f}) END AS {f}"


_PV = {"momentum_60d": 0.20, "low_volatility_20d": 0.15, "volume_ratio_5d_60d": 0.15}
_VAL = {"pb_inverse": 0.20, "pe_inverse": 0.15, "dividend_yield": 0.15}


def _composite(source: str, weights: dict[str, float], kind: str, used: str) -> str:
    """Percentile ranks by comparing all pairs of a date, then their weighted mean."""
    values = ", ".join(f"{r(f, 10)} AS {f}" for f in weights)
    ranks = ", ".join(_rank(f, f == "low_volatility_20d") for f in weights)
    top = " + ".join(["CAST(0.0 AS DOUBLE)", *(f"coalesce({f} * CAST({w} AS DOUBLE), 0.0)" for f, w in weights.items())])
    low = " + ".join(["CAST(0.0 AS DOUBLE)", *(f"CASE WHEN {f} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END" for f, w in weights.items())])
    return f"""
      SELECT date, ticker, ({top}) / nullif({low}, 0) AS composite_score, '{kind}' AS composite_type, {used} AS is_snapshot_component_used
      FROM (SELECT a.date, a.ticker, {ranks}
            FROM (SELECT date, ticker, {values} FROM {source}) a JOIN (SELECT date, {values} FROM {source}) b ON a.date = b.date GROUP BY a.date, a.ticker)"""


def _calendar(frequency: str, lag: int = 1) -> str:
    first = {"daily": "date", "weekly": "min(date) OVER (PARTITION BY isoyear(date), weekofyear(date))", "monthly": "min(date) OVER (PARTITION BY year(date), month(date))"}[frequency]
    return f"""
      SELECT date AS signal_date, execution_date, '{frequency}' AS rebalance_frequency, CAST({lag} AS INTEGER) AS execution_lag_days
      FROM (SELECT date, lead(date, {lag}) OVER (ORDER BY date) AS execution_date, {first} AS first FROM dates_d) WHERE date = first AND execution_date IS NOT NULL"""


def _chosen(scenario: str, n: int, frequency: str) -> str:
    return f"SELECT '{scenario}' AS scenario, date, ticker FROM ranked JOIN cal_{frequency} ON signal_date = date WHERE rank <= {n}"


_MODELS = {"no_cost": (0.0, 0.0), "half_cost": (0.0007125 + 0.0005, 0.0007125 + 0.0015 + 0.0005), "base_cost": (0.001425 + 0.001, 0.001425 + 0.003 + 0.001), "high_cost": (0.00285 + 0.002, 0.00285 + 0.006 + 0.002)}

PARTS = {
    "bars_w": _bars("p_brand", "CAST(date_trunc('week', day) AS DATE)"),
    "bars_d": _bars("p_brand", "day", "isodow(day) < 6"),
    "dates_d": "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS date_idx FROM (SELECT DISTINCT date FROM bars_d)",
    "grid_w": _grid("bars_w"),
    "grid_d": _grid("bars_d"),
    "pv_w": _factors("grid_w"),
    "pv_d": _factors("grid_d"),
    "valuation": f"""
      SELECT p_brand AS ticker, {r("sum(p_size) / count(*) - 25", 4)} AS pe, {r("sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) / 100000", 4)} AS pb,
             {r("sum(p_size % 7) / count(*)", 4)} AS dividend_yield FROM part GROUP BY 1""",
    "val": f"""SELECT CAST(NULL AS DATE) AS date, {AS_OF} AS as_of_date, ticker, CASE WHEN pb > 0 THEN 1.0 / pb END AS pb_inverse,
               CASE WHEN pe > 0 THEN 1.0 / pe END AS pe_inverse, dividend_yield, true AS is_snapshot FROM valuation""",
    "latest": f"""SELECT {AS_OF} AS date, pv_w.ticker, momentum_60d, low_volatility_20d, volume_ratio_5d_60d, pb_inverse, pe_inverse, dividend_yield
                  FROM pv_w LEFT JOIN val ON val.ticker = pv_w.ticker WHERE pv_w.date = (SELECT max(date) FROM pv_w)""",
    "comp_h": _composite("pv_w", _PV, "historical_price_volume", "false"),
    "comp_m": _composite("latest", _PV | _VAL, "latest_snapshot_mixed", "true"),
    "comp": "SELECT * FROM comp_h UNION ALL SELECT * FROM comp_m",
    "comp_d": _composite("pv_d", _PV, "historical_price_volume", "false"),
    "factors": " UNION ALL ".join([*(f"SELECT '{f}' AS factor, date, ticker, {f} AS value FROM pv_w" for f in _PV), "SELECT 'historical_price_volume', date, ticker, composite_score FROM comp_h"]),
    "fwd": " UNION ALL ".join(f"SELECT date, ticker, f AS forward_return, CAST({h} AS INTEGER) AS horizon FROM (SELECT date, ticker, lead(close, {h}) OVER ({_T}) / close - 1 AS f FROM grid_w) WHERE f IS NOT NULL" for h in (1, 5, 20)),
    "paired": f"SELECT f.factor, w.horizon, f.date, f.ticker, {r('f.value', 10)} AS v, {r('w.forward_return', 10)} AS y FROM factors f JOIN fwd w ON f.date = w.date AND f.ticker = w.ticker WHERE f.value IS NOT NULL",
    "ranks": """SELECT factor, horizon, date, rank() OVER (PARTITION BY factor, horizon, date ORDER BY v) + (count(*) OVER (PARTITION BY factor, horizon, date, v) - 1) / 2.0 AS a,
                rank() OVER (PARTITION BY factor, horizon, date ORDER BY y) + (count(*) OVER (PARTITION BY factor, horizon, date, y) - 1) / 2.0 AS b FROM paired""",
    "ic": """SELECT factor, horizon, date, corr(a, b) AS ic, CAST(count(*) AS INTEGER) AS asset_count FROM ranks GROUP BY ALL
             HAVING count(*) >= 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0""",
    "ics": f"""SELECT *, ic_mean / CASE WHEN {r("ic_std", 12)} > 0 THEN ic_std END AS ir FROM (
               SELECT factor, horizon, avg(ic) AS ic_mean, coalesce(stddev_samp(ic), 0) AS ic_std, CAST(count(DISTINCT date) AS INTEGER) AS valid_date_count, avg(asset_count) AS average_asset_count FROM ic GROUP BY 1, 2)""",
    "quants": f"""SELECT factor, date, ticker, value AS factor_value, CAST((k - 1) * 5 // n + 1 AS INTEGER) AS quantile FROM (
                  SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY {r("value", 10)} * CASE WHEN factor = 'low_volatility_20d' THEN -1 ELSE 1 END, ticker) AS k, count(*) OVER (PARTITION BY factor, date) AS n
                  FROM factors WHERE value IS NOT NULL)""",
    "qret": "SELECT q.factor, w.horizon, q.quantile, avg(w.forward_return) AS mean_return, CAST(count(*) AS INTEGER) AS member_count FROM quants q JOIN fwd w ON q.date = w.date AND q.ticker = w.ticker GROUP BY 1, 2, 3",
    "members": "SELECT factor, date, list(ticker) AS m FROM quants q WHERE quantile = (SELECT max(quantile) FROM quants z WHERE z.factor = q.factor) GROUP BY 1, 2",
    "turnover_f": """SELECT factor, (SELECT max(quantile) FROM quants z WHERE z.factor = s.factor) AS best_quantile, avg(1 - len(list_intersect(p, m)) / len(p)) AS average_best_bucket_turnover, CAST(count(*) AS INTEGER) AS date_count
                     FROM (SELECT factor, date, m, lag(m) OVER (PARTITION BY factor ORDER BY date) AS p FROM members) s GROUP BY factor""",
    "mono": f"""SELECT factor, horizon, coalesce(avg(up) = 1, false) AS monotonicity_pass, avg(up) AS adjacent_agreement_ratio,
                CASE WHEN count(*) >= 2 THEN arg_max(mean_return, quantile) - arg_min(mean_return, quantile) END AS top_bottom_spread,
                CASE WHEN count(*) < 2 THEN 'insufficient quantile buckets' WHEN avg(up) = 1 THEN 'monotonic increasing from Q1 to Q5' ELSE 'non-monotonic quantile-return ordering' END AS notes
                FROM (SELECT *, CASE WHEN lag(mean_return) OVER w IS NOT NULL THEN CAST({r("mean_return", 12)} >= {r("lag(mean_return) OVER w", 12)} AS INTEGER) END AS up FROM qret WINDOW w AS (PARTITION BY factor, horizon ORDER BY quantile)) GROUP BY 1, 2""",
    "best": "SELECT factor, horizon, ic_mean, ic_std, ir FROM ics QUALIFY row_number() OVER (PARTITION BY factor ORDER BY ir DESC NULLS LAST, horizon) = 1",
    "spread": "SELECT factor, horizon, max(mean_return) - min(mean_return) AS top_bottom_spread FROM qret GROUP BY 1, 2",
    "board": """SELECT n.factor, b.horizon AS best_horizon, b.ic_mean, b.ic_std, b.ir, s.top_bottom_spread, t.average_best_bucket_turnover AS avg_turnover, m.adjacent_agreement_ratio AS monotonicity_score,
                coalesce(m.monotonicity_pass, false) AS monotonicity_pass, n.snap = 0 AND b.factor IS NOT NULL AS is_historical_ready, n.snap = 0 AND b.factor IS NOT NULL AS is_backtest_candidate,
                concat_ws('; ', CASE WHEN n.snap = 1 THEN 'excluded: snapshot-only valuation semantics' END, CASE WHEN NOT m.monotonicity_pass THEN 'weak monotonicity warning' END, 'limited OHLCV coverage: 25 tickers') AS notes
                FROM (SELECT factor, 0 AS snap FROM turnover_f UNION ALL SELECT unnest(['pb_inverse', 'pe_inverse', 'dividend_yield', 'latest_snapshot_mixed']), 1) n
                LEFT JOIN best b ON b.factor = n.factor LEFT JOIN spread s ON s.factor = n.factor AND s.horizon = b.horizon
                LEFT JOIN turnover_f t ON t.factor = n.factor LEFT JOIN mono m ON m.factor = n.factor AND m.horizon = b.horizon""",
    "ranked": f"SELECT date, ticker, composite_score AS factor_score, CAST(row_number() OVER (PARTITION BY date ORDER BY {r('composite_score', 10)} DESC, ticker) AS INTEGER) AS rank FROM comp_d WHERE composite_score IS NOT NULL",
    "cal_daily": _calendar("daily"),
    "cal_weekly": _calendar("weekly"),
    "cal_monthly": _calendar("monthly"),
    "signals": "SELECT 'n5' AS scenario, 'daily' AS f, count(*) AS k FROM cal_daily UNION ALL SELECT 'weekly', 'weekly', count(*) FROM cal_weekly UNION ALL SELECT 'monthly', 'monthly', count(*) FROM cal_monthly",
    "lists": "SELECT CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS k, date, l FROM (SELECT date, list(ticker ORDER BY rank) AS l FROM ranked GROUP BY date)",
    "fold": """SELECT 0 AS k, CAST([] AS VARCHAR[]) AS held UNION ALL
               SELECT d.k, (list_concat(list_filter(d.l[1:8], lambda t: list_contains(f.held, t)), list_filter(d.l[1:5], lambda t: NOT list_contains(f.held, t))))[1:5] FROM fold f JOIN lists d ON d.k = f.k + 1""",
    "buffered": "SELECT date, unnest(held) AS ticker FROM fold JOIN lists USING (k)",
    "chosen": " UNION ALL ".join([
        "SELECT 'run' AS scenario, date, ticker FROM ranked WHERE rank <= 5",
        "SELECT 'buffer', date, ticker FROM buffered",
        *(_chosen(f"n{n}", n, "daily") for n in (3, 5, 10, 30)),
        *(_chosen(f, 5, f) for f in ("weekly", "monthly")),
    ]),
    "weights": "SELECT scenario, date, ticker, 1.0 / count(*) OVER (PARTITION BY scenario, date) AS target_weight, CAST(1 AS INTEGER) AS execution_lag_days, CAST(date + 1 AS DATE) AS execution_date FROM chosen",
    "al": "SELECT scenario, date_idx, ticker, CAST(target_weight AS DOUBLE) AS weight FROM weights JOIN dates_d ON dates_d.date = execution_date",
    "ret": "SELECT date, date_idx, ticker, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS ret FROM bars_d JOIN dates_d USING (date)",
    "gross": "SELECT scenario, ret.date_idx, sum(weight * ret) AS gross FROM al JOIN ret ON ret.ticker = al.ticker AND ret.date_idx = al.date_idx + 1 GROUP BY 1, 2",
    "moves": """SELECT scenario, date_idx, sum(greatest(d, 0)) AS buy, sum(greatest(-d, 0)) AS sell FROM (
                SELECT coalesce(a.scenario, b.scenario) AS scenario, coalesce(a.date_idx, b.date_idx + 1) AS date_idx, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d
                FROM al a FULL JOIN al b ON a.scenario = b.scenario AND a.ticker = b.ticker AND a.date_idx = b.date_idx + 1) GROUP BY 1, 2""",
    "daily": """SELECT s.scenario, d.date, d.date_idx, coalesce(gross, 0) AS gross, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, coalesce(exposure, 0) AS exposure
                FROM dates_d d CROSS JOIN (SELECT DISTINCT scenario FROM chosen) s LEFT JOIN gross g ON g.scenario = s.scenario AND g.date_idx = d.date_idx
                LEFT JOIN moves m ON m.scenario = s.scenario AND m.date_idx = d.date_idx
                LEFT JOIN (SELECT scenario, date_idx, sum(weight) AS exposure FROM al GROUP BY 1, 2) e ON e.scenario = s.scenario AND e.date_idx = d.date_idx""",
    "costs": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({b!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for n, (b, s) in _MODELS.items()) + ") t(cost, rb, rs)",
    "net": "SELECT *, buy * rb + sell * rs AS cost_returns, gross - (buy * rb + sell * rs) AS returns FROM daily CROSS JOIN costs",
    "curve": """SELECT *, equity / max(equity) OVER w - 1 AS drawdown FROM (SELECT *, product(1 + returns) OVER w * 1000000 AS equity FROM net WINDOW w AS (PARTITION BY scenario, cost ORDER BY date_idx))
                WINDOW w AS (PARTITION BY scenario, cost ORDER BY date_idx)""",
    "metrics": """SELECT *, CASE WHEN total_return >= -1 THEN pow(1 + total_return, 252.0 / n) - 1 END AS annualized_return,
                  CASE WHEN total_return >= -1 THEN pow(1 + total_return, 252.0 / n) - 1 END / nullif(annualized_volatility, 0) AS sharpe FROM (
                  SELECT scenario, cost, arg_max(equity, date_idx) / arg_min(equity, date_idx) - 1 AS total_return, count(*) AS n, stddev_pop(returns) * sqrt(252.0) AS annualized_volatility, min(drawdown) AS max_drawdown,
                         avg(CAST(returns > 0 AS INTEGER)) AS win_rate, avg(buy + sell) AS turnover, avg(exposure) AS avg_exposure, strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date
                  FROM curve GROUP BY 1, 2)""",
    "universe": """SELECT CASE WHEN s_suppkey % 5 = 0 THEN ' ' || s_suppkey || '.tw ' WHEN s_suppkey % 7 = 0 THEN 'fund.TW' ELSE lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS raw, s_name, CAST(s_nationkey AS VARCHAR) AS nation, s_suppkey FROM supplier""",
    "cleaned": """SELECT *, CASE WHEN regexp_matches(raw, '[0-9]') THEN regexp_extract(upper(trim(raw)), '[0-9]+') ELSE replace(upper(trim(raw)), '.TW', '') END AS ticker FROM universe""",
    "vendor": """SELECT CASE l_linenumber % 4 WHEN 2 THEN strftime(l_shipdate, '%Y%m%d') WHEN 3 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d_raw,
                 CASE WHEN l_linenumber % 4 <> 3 THEN CAST(l_shipdate AS DATE) END AS d, CAST(l_suppkey AS VARCHAR) AS ticker, cents,
                 CASE l_linenumber % 4 WHEN 0 THEN '--' WHEN 1 THEN CAST(cents // 1000 AS VARCHAR) || ',' || lpad(CAST(cents % 1000 AS VARCHAR), 3, '0') ELSE CAST(cents AS VARCHAR) END AS p_raw,
                 CASE WHEN l_linenumber % 4 <> 0 THEN CAST(cents AS DOUBLE) END AS p, l_quantity AS q FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
    "mom": f"SELECT date, ticker, here, close / lag(close, 60) OVER ({_T}) - 1 AS momentum FROM grid_w",
}

_M = "total_return annualized_return annualized_volatility sharpe max_drawdown turnover avg_exposure".split()


def _rs(columns: list[str] | str, table: str = "") -> str:
    columns = columns.split() if isinstance(columns, str) else columns
    return ", ".join(f"{r(table + c)} AS {c}" for c in columns)


def _ranked(lower: bool) -> str:
    side = ">" if lower else "<"
    return f"""SELECT a.date, a.ticker, {r("any_value(a.value)")} AS value,
      {r(f"CASE WHEN any_value(a.value) IS NOT NULL THEN (count(*) FILTER (WHERE b.value {side} a.value) + (count(*) FILTER (WHERE b.value = a.value) + 1) / 2.0) / count(b.value) END")} AS rank
      FROM (SELECT date, ticker, CASE WHEN volume > 100 THEN close END AS value FROM bars_w) a JOIN (SELECT date, CASE WHEN volume > 100 THEN close END AS value FROM bars_w) b ON a.date = b.date GROUP BY a.date, a.ticker"""


def _positions(select: str, source: str, frequency: str = "daily", rule: str = "top_n", buffer: int = 30) -> str:
    return f"""SELECT date, ticker, {r("factor_score")} AS factor_score, rank, {select} AS selected, CAST(5 AS INTEGER) AS top_n, '{rule}' AS selection_rule, '{frequency}' AS rebalance_frequency,
      {"true" if rule == "buffer" else "false"} AS buffer_enabled, CAST({buffer} AS INTEGER) AS drop_rank_buffer FROM {source}"""


_BRANDS = [f"Brand#{k}" for k in range(1, 26)]
_SCENARIO = "'historical_price_volume' AS factor_name"
_ALIGN = """SELECT '{name}' AS factor, NOT coalesce((SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM {f} GROUP BY date, ticker)), false) AND nd = sd AND nt = st AS is_aligned,
  coalesce((SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM {f} GROUP BY date, ticker)), false) AS has_duplicates, floor((1 - v / (nd * nt)) * 1e6 + 0.5) / 1e6 AS missing_ratio, sd AS shared_dates, st AS shared_tickers
  FROM (SELECT count(DISTINCT date) AS nd, count(DISTINCT ticker) AS nt, count(momentum) AS v, count(DISTINCT date) FILTER (WHERE date IN (SELECT date FROM bars_w)) AS sd, count(DISTINCT ticker) FILTER (WHERE ticker IN (SELECT ticker FROM bars_w)) AS st FROM {f})"""

FINAL = {
    "format_bars": "SELECT d_raw AS date, '2330' AS ticker, p_raw AS open, p_raw AS high, p_raw AS low, CAST(q AS VARCHAR) AS close, '1,000' AS volume, count(*) AS n_rows FROM vendor GROUP BY ALL",
    "failed_tickers": "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS ticker FROM customer WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL)",
    "select_tickers": "SELECT DISTINCT ticker FROM cleaned ORDER BY ticker LIMIT 12",
    "manifest": """SELECT n AS artifact_name, n || '.parquet' AS path, row_count, CAST(c AS BIGINT) AS column_count, CASE WHEN n = 'ohlcv' THEN 'lineitem,part' ELSE '' END AS source_inputs, '1.0' AS schema_version, '2024-01-01' AS created_at, '' AS notes
      FROM (SELECT 'nation' AS n, 2 AS c, count(*) AS row_count FROM nation UNION ALL SELECT 'ohlcv', 7, count(*) FROM bars_w UNION ALL SELECT 'valuation', 5, count(*) FROM valuation)""",
    "manifest_upsert": """SELECT n AS artifact_name, n || '.parquet' AS path, row_count, CAST(c AS BIGINT) AS column_count, v AS schema_version, CASE v WHEN '1.0' THEN '2024-01-01' ELSE '2023-01-01' END AS created_at, '' AS notes
      FROM (SELECT 'nation' AS n, 2 AS c, count(*) AS row_count, '0.9' AS v FROM nation UNION ALL SELECT 'ohlcv', 7, count(*), '1.0' FROM bars_w UNION ALL SELECT 'valuation', 5, count(*), '1.0' FROM valuation)""",
    "clean_ticker": "SELECT raw, ticker FROM cleaned",
    "suffix_ticker": "SELECT raw, CASE WHEN ends_with(upper(trim(raw)), '.TW') THEN upper(trim(raw)) ELSE ticker || '.TW' END AS symbol FROM cleaned",
    "numeric_coerce": "SELECT DISTINCT p_raw AS raw, p AS value FROM vendor",
    "date_coerce": "SELECT DISTINCT d_raw AS raw, d AS date FROM vendor",
    "normalize_universe": "SELECT ticker, s_name AS company_name, nation AS industry, 'TWSE' AS market, CASE s_suppkey % 3 WHEN 0 THEN DATE '1962-02-09' WHEN 1 THEN DATE '1994-09-05' END AS listed_date FROM cleaned",
    "normalize_valuation": "SELECT CAST(NULL AS DATE) AS date, CAST(p_partkey AS VARCHAR) AS ticker, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS pe, CASE WHEN p_size % 3 <> 0 THEN TRY_CAST(p_name AS DOUBLE) END AS pb, CAST(1000 + p_size AS DOUBLE) AS dividend_yield FROM part",
    "normalize_ohlcv": "SELECT d AS date, ticker, p AS open, p AS high, p AS low, q AS close, CAST(1000 AS DOUBLE) AS volume, count(*) AS n_rows FROM vendor GROUP BY ALL",
    "duplicate_keys": "SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "dense_grid": f"SELECT date, ticker, date_idx, {_rs('open high low close volume')} FROM grid_w",
    "field_matrix": "SELECT date, " + ", ".join(f"""{r(f"max(CASE WHEN ticker = '{b}' THEN close END)")} AS "{b}" """ for b in _BRANDS) + " FROM bars_w WHERE ticker IN (" + ", ".join(f"'{b}'" for b in _BRANDS) + ") GROUP BY date",
    "unpivot_factor": "SELECT d.date, t.asset, " + r("b.close") + " AS factor FROM (SELECT DISTINCT date FROM bars_w WHERE ticker IN (" + ", ".join(f"'{b}'" for b in _BRANDS) + ")) d CROSS JOIN (SELECT unnest([" + ", ".join(f"'{b}'" for b in _BRANDS) + "]) AS asset) t LEFT JOIN bars_w b ON b.date = d.date AND b.ticker = t.asset",
    "momentum": f"SELECT date, ticker, {r('momentum')} AS momentum FROM mom WHERE here",
    "return_volatility": f"SELECT date, ticker, {r(_full('stddev_samp', 'ret', 20))} AS return_volatility FROM (SELECT *, f / lag(f) OVER ({_T}) - 1 AS ret FROM (SELECT *, last_value(close IGNORE NULLS) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS f FROM grid_w))",
    "atr_over_close": f"SELECT date, ticker, {r('low_volatility_20d')} AS atr_over_close FROM pv_w WHERE here",
    "low_volatility_method": "SELECT 'full' AS panel, CASE WHEN count(high) > 0 AND count(low) > 0 THEN 'atr_20d_over_close' ELSE 'return_volatility_20d' END AS method FROM bars_w UNION ALL SELECT 'close only', 'return_volatility_20d'",
    "volume_ratio": f"SELECT date, ticker, {r('volume_ratio_5d_60d')} AS volume_ratio FROM pv_w WHERE here",
    "price_volume_factors": f"SELECT date, ticker, {_rs('momentum_60d low_volatility_20d volume_ratio_5d_60d')} FROM pv_w",
    "rank_factor_high": _ranked(False),
    "rank_factor_low": _ranked(True),
    "valuation_factors": f"SELECT date, as_of_date, ticker, {_rs('pb_inverse pe_inverse dividend_yield')}, is_snapshot FROM val",
    "historical_composite": f"SELECT * REPLACE ({r('composite_score')} AS composite_score) FROM comp_h",
    "mixed_composite": f"SELECT * REPLACE ({r('composite_score')} AS composite_score) FROM comp_m",
    "composite_frame": f"SELECT * REPLACE ({r('composite_score')} AS composite_score) FROM comp",
    "historical_factors": f"SELECT * REPLACE ({r('value')} AS value) FROM factors",
    "forward_returns": f"SELECT * REPLACE ({r('forward_return')} AS forward_return) FROM fwd",
    "rank_ic": f"SELECT * REPLACE ({r('ic')} AS ic) FROM ic",
    "ic_summary": f"SELECT factor, horizon, valid_date_count, {_rs('ic_mean ic_std average_asset_count ir')} FROM ics",
    "factor_quantiles": f"SELECT * REPLACE ({r('factor_value')} AS factor_value) FROM quants",
    "quantile_returns": f"SELECT * REPLACE ({r('mean_return')} AS mean_return) FROM qret",
    "quantile_pivot": "SELECT factor, horizon, " + ", ".join(r(f"max(CASE WHEN quantile = {k} THEN mean_return END)") + f" AS Q{k}" for k in range(1, 6)) + f", {r('max(CASE WHEN quantile = 5 THEN mean_return END) - max(CASE WHEN quantile = 1 THEN mean_return END)')} AS top_bottom_spread FROM qret GROUP BY 1, 2",
    "bucket_turnover": f"SELECT * REPLACE ({r('average_best_bucket_turnover')} AS average_best_bucket_turnover) FROM turnover_f",
    "monotonicity": f"SELECT factor, horizon, monotonicity_pass, {_rs('adjacent_agreement_ratio top_bottom_spread')}, notes FROM mono",
    "best_ic": f"SELECT factor, horizon, {_rs('ic_mean ic_std ir')} FROM best",
    "maxmin_spread": f"SELECT factor, horizon, {_rs('top_bottom_spread')} FROM spread",
    "factor_scoreboard": f"SELECT factor, best_horizon, {_rs('ic_mean ic_std ir top_bottom_spread avg_turnover monotonicity_score')}, monotonicity_pass, is_historical_ready, is_backtest_candidate, notes FROM board",
    "eligible_factors": "SELECT factor FROM board WHERE is_backtest_candidate",
    "readiness": "SELECT count(DISTINCT ticker) AS ticker_count, CAST(20 AS INTEGER) AS min_tickers, count(DISTINCT ticker) >= 20 AS is_ready FROM bars_d",
    "selected_factor_scores": f"SELECT * REPLACE ({r('composite_score')} AS composite_score) FROM comp WHERE composite_type = 'historical_price_volume' AND NOT is_snapshot_component_used",
    "topn_positions": _positions("rank <= 5", "ranked"),
    "topn_scheduled": _positions("rank <= 5", "ranked JOIN cal_weekly ON signal_date = date", "weekly"),
    "topn_buffered": _positions("list_contains(held, ticker)", "ranked JOIN lists USING (date) JOIN fold USING (k)", "daily", "buffer", 8),
    "equal_weights": f"SELECT date, ticker, {r('target_weight')} AS target_weight, execution_lag_days, execution_date FROM weights WHERE scenario = 'run'",
    "calendar_daily": "SELECT * FROM cal_daily",
    "calendar_weekly": "SELECT * FROM cal_weekly",
    "calendar_monthly": _calendar("monthly", 2),
    "cost_model": f"SELECT cost, {r('rb')} AS buy_cost_rate, {r('rs')} AS sell_cost_rate, round((rb + rs) * (SELECT sum(close * volume) FROM bars_d), 0) AS round_trip FROM costs",
    "aligned_weights": f"SELECT date, ticker, {r('weight')} AS weight FROM al JOIN dates_d USING (date_idx) WHERE scenario = 'run'",
    "asset_returns": f"SELECT date, ticker, {r('ret')} AS ret FROM ret",
    "gross_returns": f"SELECT date, {r('gross')} AS gross FROM gross JOIN dates_d USING (date_idx) WHERE scenario = 'run'",
    "turnover_daily": f"SELECT date, {_rs('buy sell')} FROM moves JOIN dates_d USING (date_idx) WHERE scenario = 'run'",
    "net_returns": f"SELECT date, cost, {_rs('cost_returns returns')} FROM net WHERE scenario = 'run'",
    "equity_curve": f"SELECT date, {r('equity', 2)} AS equity, {_rs('drawdown exposure')} FROM curve WHERE scenario = 'run' AND cost = 'base_cost'",
    "backtest_results": f"SELECT date, {r('equity', 2)} AS equity, {_rs('returns drawdown')}, {r('gross')} AS gross_returns, {_rs('cost_returns')}, {r('buy + sell')} AS turnover, {_rs('exposure')} FROM curve WHERE scenario = 'run' AND cost = 'base_cost'",
    "backtest_metrics": f"SELECT CAST(5 AS INTEGER) AS top_n, {_rs([*_M, 'win_rate'])}, start_date, end_date, (SELECT CAST(count(DISTINCT ticker) AS INTEGER) FROM bars_d) AS ticker_count, 'fallback_weight_engine' AS engine FROM metrics WHERE scenario = 'run' AND cost = 'base_cost'",
    "cost_scenarios": f"SELECT cost AS scenario, {_SCENARIO}, CAST(5 AS INTEGER) AS top_n, 'daily' AS rebalance_frequency, true AS buffer_enabled, {_rs(_M)}, {r('(SELECT total_return FROM metrics WHERE scenario = ' + chr(39) + 'buffer' + chr(39) + ' AND cost = ' + chr(39) + 'no_cost' + chr(39) + ') - total_return')} AS cost_drag, 'fallback_weight_engine' AS engine, start_date, end_date FROM metrics WHERE scenario = 'buffer'",
    "topn_sensitivity": f"SELECT CAST(scenario[2:] AS INTEGER) AS top_n, {_SCENARIO}, 'daily' AS rebalance_frequency, false AS buffer_enabled, {_rs([m for m in _M if m != 'annualized_volatility'])}, 'fallback_weight_engine' AS engine, CASE WHEN u < CAST(scenario[2:] AS INTEGER) THEN 'universe_size=' || u || ' < top_n=' || scenario[2:] ELSE '' END AS notes FROM metrics, (SELECT count(DISTINCT ticker) AS u FROM comp_d) WHERE cost = 'base_cost' AND scenario IN ('n3', 'n5', 'n10', 'n30')",
    "rebalance_sensitivity": f"SELECT f AS rebalance_frequency, {_SCENARIO}, CAST(5 AS INTEGER) AS top_n, false AS buffer_enabled, CAST(k AS INTEGER) AS rebalance_count, {_rs([m for m in _M if m != 'annualized_volatility'])}, 'fallback_weight_engine' AS engine, 'rebalance_count=' || k AS notes FROM metrics JOIN signals c USING (scenario) WHERE cost = 'base_cost'",
    "turnover_diagnostics": f"""WITH e AS (SELECT CAST(dense_rank() OVER (ORDER BY execution_date) AS INTEGER) AS k, ticker, CAST(target_weight AS DOUBLE) AS w FROM weights WHERE scenario = 'run'),
      mv AS (SELECT k, sum(greatest(d, 0)) AS b, sum(greatest(-d, 0)) AS s FROM (SELECT coalesce(x.k, y.k + 1) AS k, coalesce(x.w, 0) - coalesce(y.w, 0) AS d FROM e x FULL JOIN e y ON x.ticker = y.ticker AND x.k = y.k + 1) GROUP BY k),
      t AS (SELECT mv.*, b + s AS t, h FROM mv JOIN (SELECT k, count(*) AS h FROM e WHERE w > 0 GROUP BY k) USING (k))
      SELECT metric, {r("value")} AS value, notes FROM (
        SELECT 'average_daily_turnover' AS metric, avg(t) AS value, 'sum of |Δweight| per day' AS notes FROM t UNION ALL SELECT 'median_daily_turnover', median(t), 'median daily' FROM t
        UNION ALL SELECT 'max_daily_turnover', max(t), 'single-day peak' FROM t UNION ALL SELECT 'annualized_turnover_estimate', avg(t) * 252, 'avg_daily × 252' FROM t
        UNION ALL SELECT 'avg_holdings', avg(h), 'mean non-zero tickers per date' FROM t UNION ALL SELECT 'avg_buys_per_rebalance', avg(b), 'mean positive weight increase on active dates' FROM t WHERE t > 0
        UNION ALL SELECT 'avg_sells_per_rebalance', avg(s), 'mean positive weight decrease on active dates' FROM t WHERE t > 0
        UNION ALL SELECT 'estimated_cost_drag', avg(t) * ((0.001425 + 0.001 + 0.001425 + 0.003 + 0.001) / 2) * 252, 'avg_daily × one_way_cost × 252' FROM t)""",
    "realism_verdicts": f"""SELECT {_rs('no_cost_return base_cost_return')}, no_cost_return > base_cost_return + 0.05 AS cost_is_material, CASE WHEN no_cost_return > -0.1 THEN 'cost-dominated' WHEN no_cost_return < -0.5 THEN 'weak factor' ELSE 'both' END AS diagnosis,
      {_rs('daily_turnover weekly_turnover')}, weekly_turnover < 0.5 * daily_turnover AS weekly_halves_turnover FROM (
      SELECT max(total_return) FILTER (WHERE scenario = 'n5' AND cost = 'no_cost') AS no_cost_return, max(total_return) FILTER (WHERE scenario = 'n5' AND cost = 'base_cost') AS base_cost_return,
             max(turnover) FILTER (WHERE scenario = 'n5' AND cost = 'base_cost') AS daily_turnover, max(turnover) FILTER (WHERE scenario = 'weekly' AND cost = 'base_cost') AS weekly_turnover FROM metrics)""",
    "missing_ratio_columns": " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r(f'avg(CAST({c} IS NULL AS INTEGER))', 4)} AS missing_ratio FROM pv_w" for c in ("date", "ticker", *_PV)),
    "missing_ratio_overall": f"SELECT {r('(' + ' + '.join(f'avg(CAST({c} IS NULL AS INTEGER))' for c in ('date', 'ticker', *_PV)) + ') / 5')} AS missing_ratio FROM pv_w",
    "date_range": "SELECT strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') AS date_range FROM bars_w",
    "data_quality": """WITH b AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker FROM lineitem), u AS (SELECT count(DISTINCT c_custkey) AS n, count(*) AS m FROM customer), g AS (SELECT count(DISTINCT ticker) AS n, count(*) AS m FROM b)
      SELECT 'universe_total_tickers' AS metric, CAST(n AS VARCHAR) AS value FROM u UNION ALL SELECT 'universe_rows', CAST(m AS VARCHAR) FROM u UNION ALL SELECT 'valuation_rows', CAST(count(*) AS VARCHAR) FROM valuation
      UNION ALL SELECT 'ohlcv_successful_tickers', CAST(n AS VARCHAR) FROM g UNION ALL SELECT 'ohlcv_rows', CAST(m AS VARCHAR) FROM g
      UNION ALL SELECT 'ohlcv_date_range', strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') FROM b UNION ALL SELECT 'ohlcv_requested_tickers', CAST(n AS VARCHAR) FROM u
      UNION ALL SELECT 'ohlcv_failed_tickers', CAST(count(DISTINCT c_custkey) AS VARCHAR) FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT ticker FROM b)
      UNION ALL SELECT 'ohlcv_coverage_ratio', printf('%.4f', floor(g.n / u.n * 1e4 + 0.5) / 1e4) FROM g, u""",
    "factor_alignment": _ALIGN.format(name="momentum", f="here_mom") + " UNION ALL " + _ALIGN.format(name="shifted", f="off_mom"),
    "factor_readiness": "SELECT count(*) > 0 AND count(DISTINCT date) = count(DISTINCT date) FILTER (WHERE date IN (SELECT date FROM bars_w)) AS is_ready, count(DISTINCT date) FILTER (WHERE date IN (SELECT date FROM bars_w)) AS shared_dates, count(DISTINCT ticker) FILTER (WHERE ticker IN (SELECT ticker FROM bars_w)) AS shared_assets FROM here_mom",
    "lookahead_check": f"SELECT count(*) > 0 AS is_backward_looking, CAST(60 AS INTEGER) AS lookback, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM here_mom WHERE date <= {CUT}",
    "snapshot_limitation": "SELECT 'snapshot' AS panel, 'valuation inputs are latest snapshot data because the valuation date column is empty; they are not historical point-in-time factors.' AS limitation UNION ALL SELECT 'dated', 'Valuation inputs include dated observations.'",
    "composite_breakdown": "SELECT composite_type, count(*) AS n_rows, strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') AS date_range, bool_or(is_snapshot_component_used) AS is_snapshot_component_used, NOT bool_or(is_snapshot_component_used) AS historical_backtest_ready FROM comp GROUP BY 1",
    "artifact_shapes": "SELECT 'ohlcv' AS artifact, count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, count(DISTINCT ticker) AS n_tickers FROM bars_w UNION ALL SELECT 'factors_price_volume', count(*), 5, count(DISTINCT ticker) FROM pv_w UNION ALL SELECT 'factors_valuation_snapshot', count(*), 7, count(DISTINCT ticker) FROM val UNION ALL SELECT 'factors_composite', count(*), 5, count(DISTINCT ticker) FROM comp",
}
FINAL |= {
    "manifest_append": FINAL["manifest_upsert"],
    "parquet_round_trip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "landed_json": "SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier",
    "numeric_suffixes": """SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN q || 'd' WHEN 1 THEN q || 'f' WHEN 2 THEN '0x' || q || 'p3' WHEN 3 THEN q || '.5e1' ELSE q END AS raw,
      CASE l_linenumber % 5 WHEN 3 THEN CAST(q AS DOUBLE) * 10 + 5 WHEN 4 THEN CAST(q AS DOUBLE) END AS value
      FROM (SELECT l_linenumber, CAST(CAST(round(l_quantity) AS INTEGER) AS VARCHAR) AS q FROM lineitem)""",
    "close_only_factors": f"""SELECT v.date, v.ticker, {r("p.momentum_60d")} AS momentum_60d, v.return_volatility AS low_volatility_20d, {r("p.volume_ratio_5d_60d")} AS volume_ratio_5d_60d, panel
      FROM ({FINAL["return_volatility"]}) v JOIN pv_w p ON v.date = p.date AND v.ticker = p.ticker CROSS JOIN (SELECT unnest(['close only', 'all null']) AS panel)""",
}
_HELD_RUN = "scenario = 'weekly'"
PARTS |= {
    "made": f"SELECT d.date_idx, max(m.date_idx) AS made FROM dates_d d JOIN (SELECT DISTINCT date_idx FROM al WHERE {_HELD_RUN}) m ON m.date_idx <= d.date_idx GROUP BY 1",
    "keeps": f"SELECT made.date_idx, ticker, weight FROM made JOIN al ON al.date_idx = made.made WHERE {_HELD_RUN}",
    "kept_moves": """SELECT date_idx, sum(greatest(d, 0)) AS buy, sum(greatest(-d, 0)) AS sell FROM (
                     SELECT coalesce(a.date_idx, b.date_idx + 1) AS date_idx, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM keeps a FULL JOIN keeps b ON a.ticker = b.ticker AND a.date_idx = b.date_idx + 1) GROUP BY 1""",
    "kept_daily": """SELECT d.date, d.date_idx, coalesce((SELECT sum(k.weight * ret.ret) FROM keeps k JOIN ret ON ret.ticker = k.ticker AND ret.date_idx = k.date_idx + 1 WHERE ret.date_idx = d.date_idx), 0) AS gross,
                     coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, coalesce(e, 0) AS exposure FROM dates_d d LEFT JOIN kept_moves m ON m.date_idx = d.date_idx LEFT JOIN (SELECT date_idx, sum(weight) AS e FROM keeps GROUP BY 1) x ON x.date_idx = d.date_idx""",
    "kept_net": "SELECT *, buy * rb + sell * rs AS cost_returns, gross - (buy * rb + sell * rs) AS returns FROM kept_daily JOIN costs ON cost = 'base_cost'",
    "kept_curve": """SELECT *, equity / max(equity) OVER (ORDER BY date_idx) - 1 AS drawdown FROM (SELECT *, product(1 + returns) OVER (ORDER BY date_idx) * 1000000 AS equity FROM kept_net)""",
}
_CUTS = "(SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in ("1993-06-30", "1993-07-12", "1995-01-02", "1996-06-30", "1997-12-31")) + "]) AS cut)"
PARTS["cut_reads"] = f"""SELECT date, ticker, cut, leak, date <= cut AND leak AND read > cut AS changed FROM (
      SELECT date, ticker, false AS leak, date AS read FROM grid_w WHERE here UNION ALL
      SELECT date, ticker, true, CASE WHEN close IS NOT NULL AND lead(close, 5) OVER ({_T}) IS NOT NULL THEN lead(date, 5) OVER ({_T}) ELSE date END FROM grid_w QUALIFY here) JOIN {_CUTS} ON date <= cut"""
FINAL |= {
    "lookahead_checks": "SELECT CASE WHEN leak THEN 'leak' ELSE 'momentum' END AS factor, cut, count(*) FILTER (WHERE changed) = 0 AS is_backward_looking, CAST(60 AS INTEGER) AS lookback, count(*) AS rows, count(*) FILTER (WHERE changed) AS changed FROM cut_reads GROUP BY leak, cut",
    "latest_reads": """SELECT CASE WHEN leak THEN 'leak' ELSE 'momentum' END AS factor, latest_read, leaks, count(*) AS n_rows, min(date) AS first, max(date) AS last FROM (
      SELECT leak, date, ticker, min(cut) FILTER (WHERE bad IS NULL OR cut > bad) AS latest_read, any_value(bad IS NOT NULL) AS leaks FROM (SELECT *, max(cut) FILTER (WHERE changed) OVER (PARTITION BY leak, date, ticker) AS bad FROM cut_reads) GROUP BY leak, date, ticker) GROUP BY 1, 2, 3""",
    "backtest_held": f"SELECT date, {r('equity', 2)} AS equity, {_rs('returns drawdown')}, {r('gross')} AS gross_returns, {_rs('cost_returns')}, {r('buy + sell')} AS turnover, {_rs('exposure')} FROM kept_curve",
    "asset_returns_unfilled": f"SELECT date, ticker, {r('coalesce(ret, 0)')} AS ret FROM (SELECT *, close / lag(close) OVER ({_T}) - 1 AS ret FROM grid_d) WHERE here",
    "weights_next_trading_day": f"SELECT w.date, ticker, {r('target_weight')} AS target_weight, CAST(2 AS INTEGER) AS execution_lag_days, n.execution_date FROM weights w JOIN (SELECT date, lead(date, 2) OVER (ORDER BY date) AS execution_date FROM dates_d) n ON n.date = w.date WHERE scenario = 'run' AND n.execution_date IS NOT NULL",
    "landed_array": """SELECT o_orderkey, o_custkey, o_totalprice, 'a "}" ' || chr(92) || ' ],{ of ' || o_orderstatus AS note FROM orders""",
    "date_forms": "SELECT 'mixed' AS form, CASE WHEN l_linenumber % 7 <> 6 THEN CAST(l_shipdate AS DATE) END AS date, count(*) AS n_rows FROM lineitem GROUP BY 2 UNION ALL SELECT 'european', CAST(l_shipdate AS DATE), count(*) FROM lineitem GROUP BY 2",
    "field_blocks": f"""SELECT row_block, column_block, CAST(max(n_rows) AS INTEGER) AS n_rows, CAST(max(n_columns) AS INTEGER) AS n_columns, CAST(count(close) AS INTEGER) AS n_values, coalesce(sum(CAST(round(close * 10000) AS BIGINT)), 0)::BIGINT AS total
      FROM (SELECT CAST((date_idx - 1) // 128 AS INTEGER) AS row_block, CAST((k - 1) // 16 AS INTEGER) AS column_block, close, least(128, max(date_idx) OVER () - (date_idx - 1) // 128 * 128) AS n_rows, least(16, max(k) OVER () - (k - 1) // 16 * 16) AS n_columns
            FROM (SELECT *, dense_rank() OVER (ORDER BY ticker) AS k FROM grid_w)) GROUP BY 1, 2""",
    "field_blocks_long": f"SELECT date, ticker AS asset, {r('close')} AS factor FROM grid_w",
    "line_price_ranks": """SELECT year, cents, rank() OVER (PARTITION BY year ORDER BY cents DESC) AS first, rank() OVER (PARTITION BY year ORDER BY cents DESC) + k - 1 AS last, rank() OVER (PARTITION BY year ORDER BY cents DESC) + (k - 1) / 2.0 AS average,
      rank() OVER (PARTITION BY year ORDER BY cents DESC) + (k - 1) / 2.0 AS same, n_lines FROM (SELECT *, count(*) OVER (PARTITION BY year, cents) AS k, count(*) OVER (PARTITION BY year) AS n_lines FROM (
      SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)) QUALIFY row_number() OVER (PARTITION BY year, cents) = 1""",
    "rank_factor_spread": FINAL["rank_factor_low"],
    "rank_ic_spread": FINAL["rank_ic"],
    "factor_quantiles_spread": FINAL["factor_quantiles"],
    "ranked_scores_spread": f"SELECT * REPLACE ({r('factor_score')} AS factor_score) FROM ranked",
}
PARTS["here_mom"] = "SELECT date, ticker, momentum FROM mom WHERE here"
PARTS["off_mom"] = "SELECT CAST(date + 1 AS DATE) AS date, ticker, momentum FROM mom WHERE here"


def _needs(sql: str, seen: set[str]) -> list[str]:
    out = []
    for name in sorted(set(re.findall(r"[a-z_]+", sql)) & set(PARTS)):
        if name not in seen:
            seen.add(name)
            out += [*_needs(PARTS[name], seen), name]
    return out


def statements() -> dict[str, str]:
    out = {}
    for key, sql in FINAL.items():
        names = _needs(sql, set())
        inner = ""
        if sql.lstrip().startswith("WITH "):
            # a statement's own subqueries follow the shared ones
            head, body = _own(sql)
            inner, sql = head, body
        parts = [f"{n} AS ({PARTS[n]})" for n in names] + ([inner] if inner else [])
        out[key] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
    return out


def statements_by_supplier(names: list[str]) -> dict[str, str]:
    """The same statements over bars by supplier for every day."""
    bars = _bars("CAST(l_suppkey AS VARCHAR)", "day", parts="")
    every = statements()
    return {f"{n}_by_supplier": every[n].replace(PARTS["bars_w"], bars).replace(PARTS["bars_d"], bars) for n in names}


def _own(sql: str) -> tuple[str, str]:
    """Split "WITH a AS (...), b AS (...) SELECT ..." into its subqueries and its body."""
    text, depth = sql.strip()[5:], 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and text[i:].startswith("SELECT"):
            return text[:i].strip(), text[i:]
    raise ValueError(sql)
