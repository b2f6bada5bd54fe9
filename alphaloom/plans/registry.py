"""Registered queries over the factor-research operators; an independent SQL text for each is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions import scalars as S
from alphaloom.operators import analysis as A
from alphaloom.operators import backtest as B
from alphaloom.operators import factors as X
from alphaloom.operators import panel as P
from alphaloom.operators import portfolio as G
from alphaloom.operators import quality as Q
from alphaloom.operators import scoreboard as R
from alphaloom.operators.ranks import dealt, spread_ranks
from alphaloom.plans import demo, oracle
from alphaloom.sources import tables as T
from alphaloom.sources.scratch import scratch, stored

HORIZONS, TOP, BUFFER, GRID = [1, 5, 20], 5, 8, [3, 5, 10, 30]
MODELS = [B.CostModel("no_cost", 0.0, 0.0, 0.0, 0.0), B.CostModel("half_cost", 0.0007125, 0.0007125, 0.0015, 0.0005), B.CostModel(), B.CostModel("high_cost", 0.00285, 0.00285, 0.006, 0.002)]
ONE = [("run", TOP, "daily", False, 30)]
#: Orders of one landed array, about.
ARRAY_ROWS = 1_000_000


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at six digits."""
    return df.withColumns({c: S.rounded(F.col(c), 6) for c in columns})


class Case:
    """Inputs of one query, built when asked for.

    What a query reads several times (``keep``) is written once to the shared folder and read back: its plan ends
    there, Spark knows its size, and a lost executor costs no more than the step at hand. What it reads once stays
    part of its plan. ``bars`` swaps in another panel for both.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, bars: Callable[[SparkSession, str], DataFrame] | None = None):
        self.spark, self.dir = spark, sf_dir
        self._weekly, self._daily = bars or demo.bars_w, bars or demo.bars_d
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
        if name not in self._made:
            if not keep:
                return make()
            self._made[name] = stored(make(), name)
        return self._made[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def w(self) -> DataFrame:
        """Weekly bars."""
        return self.wi().drop("date_idx")

    def wi(self) -> DataFrame:
        """Weekly bars with date_idx."""
        return self._once("w", lambda: P.with_date_idx(self._weekly(self.spark, self.dir)))

    def d(self) -> DataFrame:
        """Daily bars with date_idx."""
        return self._once("d", lambda: P.with_date_idx(self._daily(self.spark, self.dir)))

    def pv(self, keep: bool = False) -> DataFrame:
        return self._once("pv", lambda: X.price_volume_factors(self.wi()), keep)

    def val(self) -> DataFrame:
        return X.valuation_factors(demo.valuation(self.spark, self.dir), demo.AS_OF)

    def composite(self) -> DataFrame:
        return X.composite_frame(self.pv(True), self.val())

    def known(self) -> DataFrame:
        """Factors at bars, where alone they have values."""
        return self._once("known", lambda: X.price_volume_factors(self.wi(), cells=False))

    def factors(self, keep: bool = False) -> DataFrame:
        """Factors in rows, for what reads their values only."""
        return self._once("factors", lambda: A.historical_factors(self.known(), X.historical_composite(self.known())), keep)

    def fwd(self, keep: bool = False) -> DataFrame:
        return self._once("fwd", lambda: A.forward_returns(self.wi(), HORIZONS), keep)

    def quantiles(self, keep: bool = False) -> DataFrame:
        return self._once("quantiles", lambda: A.factor_quantiles(self.factors()), keep)

    def qr(self, keep: bool = False) -> DataFrame:
        return self._once("qr", lambda: A.quantile_returns(self.quantiles(), self.fwd()), keep)

    def ic(self) -> DataFrame:
        return A.rank_ic(self.factors(), self.fwd())

    def board(self) -> DataFrame:
        for shared in (self.factors, self.fwd, self.quantiles, self.qr):
            shared(True)
        # the scoreboard reads each table for its factors' names and for their values
        ic = self._once("ics", lambda: A.ic_summary(self.ic()))
        turnover = self._once("turnover", lambda: A.bucket_turnover(self.quantiles()))
        return R.factor_scoreboard(ic, self.qr(), turnover, A.monotonicity(self.qr()), 25)

    def scores(self, keep: bool = True) -> DataFrame:
        """Composite of the daily panel."""
        return self._once("scores", lambda: X.historical_composite(X.price_volume_factors(self.d(), cells=False)), keep)

    def grid(self, rows=ONE) -> DataFrame:
        return G.scenarios(self.spark, rows)

    def positions(self, rows=ONE, scheduled: bool = False) -> DataFrame:
        return G.topn_positions(self.scores(any(r[3] for r in rows)), self.grid(rows), G.calendars(self.d()) if scheduled else None)

    def weights(self, keep: bool = False) -> DataFrame:
        return self._once("weights", lambda: G.equal_weights(G.topn_positions(self.scores(False), self.grid(), near_only=True)), keep)

    def aligned(self) -> DataFrame:
        return B.aligned_weights(self.weights(), self.d())

    def run(self) -> tuple[DataFrame, DataFrame]:
        return B.backtest(self.d(), self.weights(), self.grid(), B.cost_scenarios_df(self.spark, [B.CostModel()]))


# --- A, B: sources and normalisation


def format_bars(c: Case) -> DataFrame:
    return T.format_bars(demo.raw_bars(c.spark, c.dir).drop("Code"), F.lit("2330")).groupBy("date", "ticker", "open", "high", "low", "close", "volume").agg(F.count(F.lit(1)).alias("n_rows"))


def failed_tickers(c: Case) -> DataFrame:
    """Customers' keys as what was asked for, lines' supplier keys as what came."""
    return T.failed_tickers(*_asked_and_came(c))


def _asked_and_came(c: Case) -> tuple[DataFrame, DataFrame]:
    asked = c.read("customer").select(F.col("c_custkey").cast("string").alias("ticker"))
    return asked, c.read("lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("ticker"))


def select_tickers(c: Case) -> DataFrame:
    return T.select_tickers(T.normalize_universe(demo.raw_universe(c.spark, c.dir)), 12)


def _named(c: Case) -> dict[str, DataFrame]:
    return {"nation": c.read("nation").select("n_nationkey", "n_name"), "ohlcv": c.w(), "valuation": demo.valuation(c.spark, c.dir)}


def manifest(c: Case) -> DataFrame:
    return T.manifest(_named(c), "1.0", {"ohlcv": ["lineitem", "part"]}, "2024-01-01").withColumn("source_inputs", F.array_join("source_inputs", ","))


def manifest_upsert(c: Case) -> DataFrame:
    named = _named(c)
    old = T.manifest({k: named[k] for k in ("nation", "ohlcv")}, "0.9", created_at="2023-01-01")
    new = T.manifest({k: named[k] for k in ("ohlcv", "valuation")}, "1.0", created_at="2024-01-01")
    return T.manifest_upsert(old, new).drop("source_inputs")


def manifest_append(c: Case) -> DataFrame:
    """Two rounds into one stored manifest."""
    named, path = _named(c), scratch(c.spark, "manifest")
    T.append_manifest(c.spark, path, T.manifest({k: named[k] for k in ("nation", "ohlcv")}, "0.9", created_at="2023-01-01"))
    return T.append_manifest(c.spark, path, T.manifest({k: named[k] for k in ("ohlcv", "valuation")}, "1.0", created_at="2024-01-01")).drop("source_inputs")


def parquet_round_trip(c: Case) -> DataFrame:
    return T.load(c.spark, T.save(c.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), scratch(c.spark, "orders")))


def landed_json(c: Case) -> DataFrame:
    """Suppliers landed as one JSON array per nation, and read back."""
    path = scratch(c.spark, "landed")
    rows = c.read("supplier").select("s_nationkey", F.struct("s_suppkey", "s_name", "s_acctbal").alias("r"))
    arrays = rows.groupBy("s_nationkey").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return T.read_landed_json(c.spark, path, "s_suppkey long, s_name string, s_acctbal double").select("s_suppkey", "s_name", "s_acctbal", F.col("s_nationkey").cast("int").alias("s_nationkey"))


def clean_ticker(c: Case) -> DataFrame:
    return demo.raw_universe(c.spark, c.dir).select(F.col("StockCode").alias("raw"), S.clean_ticker(F.col("StockCode")).alias("ticker"))


def suffix_ticker(c: Case) -> DataFrame:
    return demo.raw_universe(c.spark, c.dir).select(F.col("StockCode").alias("raw"), S.suffix_ticker(F.col("StockCode")).alias("symbol"))


def numeric_coerce(c: Case) -> DataFrame:
    raw = demo.raw_bars(c.spark, c.dir)
    return raw.select(F.col("Open").alias("raw"), S.numeric(F.col("Open")).alias("value")).distinct()


def numeric_suffixes(c: Case) -> DataFrame:
    """Texts that a cast alone would take for numbers."""
    size, line = F.round("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    raw = F.when(line == 0, F.concat(size, F.lit("d"))).when(line == 1, F.concat(size, F.lit("f"))).when(line == 2, F.concat(F.lit("0x"), size, F.lit("p3"))).when(line == 3, F.concat(size, F.lit(".5e1"))).otherwise(size)
    return c.read("lineitem").select(raw.alias("raw")).distinct().withColumn("value", S.numeric(F.col("raw")))


def date_coerce(c: Case) -> DataFrame:
    return demo.raw_bars(c.spark, c.dir).select(F.col("Date").alias("raw"), S.to_date_lenient(F.col("Date")).alias("date")).distinct()


def date_forms(c: Case) -> DataFrame:
    """Both columns of dates, each read in the order that its values vote for."""
    raw = demo.raw_dates(c.spark, c.dir)
    out = None
    for name in ("mixed", "european"):
        bars = T.normalize_ohlcv(raw.select(F.col(name).alias("Date"), F.col(name).alias("Code"))).select(F.lit(name).alias("form"), "date")
        out = bars if out is None else out.unionByName(bars)
    return out.groupBy("form", "date").agg(F.count(F.lit(1)).alias("n_rows"))


def landed_array(c: Case) -> DataFrame:
    """All orders landed as JSON arrays of about a million, a file each, with inner objects and with braces and quotes in texts, and read back in splits.

    A file is what one task writes, so arrays have a size and their number grows with the orders.
    """
    path, orders = scratch(c.spark, "array"), c.read("orders")
    arrays = F.lit(-(-orders.count() // ARRAY_ROWS) or 1)
    note = F.concat(F.lit('a "}" \\ ],{ of '), "o_orderstatus")
    j = F.to_json(F.struct("o_orderkey", "o_custkey", F.struct("o_totalprice", note.alias("note")).alias("more")))
    within = Window.partitionBy("array").orderBy("o_orderkey")
    rows = orders.select(F.pmod(F.xxhash64("o_orderkey"), arrays).alias("array"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    rows = dealt(rows, ["array"]).withColumns({"head": F.row_number().over(within) == 1, "end": F.lead(F.lit(True)).over(within).isNull()}).sortWithinPartitions("array", "o_orderkey")
    rows.select("array", F.concat(F.when(F.col("head"), "[").otherwise(","), j, F.when(F.col("end"), "]").otherwise("")).alias("value")).write.partitionBy("array").text(path)
    back = T.read_landed_json(c.spark, path, "o_orderkey long, o_custkey long, more struct<o_totalprice:double,note:string>")
    return back.select("o_orderkey", "o_custkey", "more.o_totalprice", "more.note")


def normalize_ohlcv(c: Case) -> DataFrame:
    rows = T.normalize_ohlcv(demo.raw_bars(c.spark, c.dir))
    return rows.groupBy(*T.BARS).agg(F.count(F.lit(1)).alias("n_rows"))


# --- C: panel


def duplicate_keys(c: Case) -> DataFrame:
    rows = c.read("lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("ticker"))
    return P.duplicate_keys(rows)


def dense_grid(c: Case) -> DataFrame:
    return _r(P.dense_grid(c.w()), "open", "high", "low", "close", "volume")


def field_matrix(c: Case) -> DataFrame:
    """Every ticker is a column, so their number is bounded by what a schema holds."""
    brands = sorted(r[0] for r in c.w().select("ticker").distinct().collect())
    return _r(P.field_matrix(c.w(), "close", brands), *brands)


def unpivot_factor(c: Case) -> DataFrame:
    return _r(P.unpivot_factor(field_matrix(c)), "factor")


def field_blocks(c: Case) -> DataFrame:
    """The close matrix in blocks, each summed up."""
    blocks = P.field_blocks(c.wi(), "close", 128, 16).blocks
    total = F.aggregate(F.filter("values", lambda v: v.isNotNull()), F.lit(0).cast("long"), lambda s, v: s + F.round(v * 10_000).cast("long"))
    return blocks.select("row_block", "column_block", "n_rows", "n_columns", F.size(F.filter("values", lambda v: v.isNotNull())).alias("n_values"), total.alias("total"))


def field_blocks_long(c: Case) -> DataFrame:
    return _r(P.field_blocks(c.wi(), "close", 128, 16).to_long(), "factor")


# --- D: factors


def line_price_ranks(c: Case) -> DataFrame:
    """Lines ranked by price within their ship year, by ranges: cross-sections that grow with the tables."""
    lines = c.read("lineitem").select(F.year("l_shipdate").alias("year"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_orderkey", "l_linenumber")
    ranked = spread_ranks(lines, ["year"], "cents", descending=True, ties=["l_orderkey", "l_linenumber"])
    return ranked.groupBy("year", "cents").agg(F.min("_position").alias("first"), F.max("_position").alias("last"), F.min("_average").alias("average"), F.max("_average").alias("same"), F.max("_count").alias("n_lines"))


def close_only_factors(c: Case) -> DataFrame:
    """The factor frame of a panel without highs and lows, and of one where they are all null."""
    bare = X.price_volume_factors(c.wi().drop("high", "low")).withColumn("panel", F.lit("close only"))
    none = F.lit(None).cast("double")
    return _r(bare.unionByName(X.price_volume_factors(c.wi().withColumns({"high": none, "low": none})).withColumn("panel", F.lit("all null"))), *FACTORS)


def low_volatility_method(c: Case) -> DataFrame:
    bare = c.w().drop("high", "low")
    return X.low_volatility_method(c.w()).withColumn("panel", F.lit("full")).unionByName(X.low_volatility_method(bare).withColumn("panel", F.lit("close only")))


def _ranked(c: Case, direction: str, spread: bool | None = None) -> DataFrame:
    return _r(S.rank_factor(c.w().select("date", "ticker", F.when(F.col("volume") > 100, F.col("close")).alias("value")), "value", "date", direction, spread), "rank", "value")


FACTORS = ["momentum_60d", "low_volatility_20d", "volume_ratio_5d_60d"]


# --- E, F


def quantile_pivot(c: Case) -> DataFrame:
    return _r(A.quantile_pivot(c.qr()), "Q1", "Q2", "Q3", "Q4", "Q5", "top_bottom_spread")


def factor_scoreboard(c: Case) -> DataFrame:
    return _r(c.board(), "ic_mean", "ic_std", "ir", "top_bottom_spread", "avg_turnover", "monotonicity_score")


# --- G, H


POSITIONS = ["date", "ticker", "factor_score", "rank", "selected", "top_n", "selection_rule", "rebalance_frequency", "buffer_enabled", "drop_rank_buffer"]


def _positions(df: DataFrame) -> DataFrame:
    return _r(df.select(*POSITIONS), "factor_score")


def aligned_weights(c: Case) -> DataFrame:
    return _r(c.aligned().join(P.date_index(c.d()), "date_idx").select("date", "ticker", "weight"), "weight")


def weights_next_trading_day(c: Case) -> DataFrame:
    weights = G.equal_weights(c.positions(), 2, "trading_day", c.d())
    return _r(weights.drop("scenario"), "target_weight")


def backtest_held(c: Case) -> DataFrame:
    """Weekly signals whose weights are held until the next ones."""
    grid = c.grid([("weekly", TOP, "weekly", False, 30)])
    weights = c._once("held", lambda: G.equal_weights(G.topn_positions(c.scores(False), grid, G.calendars(c.d()), near_only=True)))
    out = B.backtest(c.d(), weights, grid, B.cost_scenarios_df(c.spark, [B.CostModel()]), hold="ffill")[0]
    out = out.select("date", "equity", "returns", "drawdown", "gross_returns", "cost_returns", "turnover", "exposure").withColumn("equity", S.rounded(F.col("equity"), 2))
    return _r(out, "returns", "drawdown", "gross_returns", "cost_returns", "turnover", "exposure")


def cost_model(c: Case) -> DataFrame:
    """What each model costs the orders' lines, bought and sold once."""
    costs = B.cost_scenarios_df(c.spark, MODELS)
    volume = c.d().agg(F.sum(F.col("close") * F.col("volume")).alias("v"))
    out = volume.join(costs).select("cost", "buy_cost_rate", "sell_cost_rate", F.round((F.col("buy_cost_rate") + F.col("sell_cost_rate")) * F.col("v"), 0).alias("round_trip"))
    return _r(out, "buy_cost_rate", "sell_cost_rate")


def _per_date(c: Case, df: DataFrame, *columns: str) -> DataFrame:
    return _r(df.join(P.date_index(c.d()), "date_idx").select("date", *columns), *columns)


def backtest_results(c: Case) -> DataFrame:
    out = c.run()[0].select("date", "equity", "returns", "drawdown", "gross_returns", "cost_returns", "turnover", "exposure")
    return _r(out.withColumn("equity", S.rounded(F.col("equity"), 2)), "returns", "drawdown", "gross_returns", "cost_returns", "turnover", "exposure")


METRICS = ["total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "turnover", "avg_exposure"]


def backtest_metrics(c: Case) -> DataFrame:
    return _r(c.run()[1].drop("scenario", "cost", "cost_model_summary"), *METRICS, "win_rate")


def cost_scenarios(c: Case) -> DataFrame:
    return _r(B.cost_scenarios(c.d(), c.scores(), MODELS, TOP, "daily", BUFFER), *METRICS, "cost_drag")


def topn_sensitivity(c: Case) -> DataFrame:
    return _r(B.topn_sensitivity(c.d(), c.scores(), GRID), *(m for m in METRICS if m != "annualized_volatility"))


def _rebalance(c: Case) -> DataFrame:
    return B.rebalance_sensitivity(c.d(), c.scores(), top_n=TOP)


def rebalance_sensitivity(c: Case) -> DataFrame:
    return _r(_rebalance(c), *(m for m in METRICS if m != "annualized_volatility"))


def realism_verdicts(c: Case) -> DataFrame:
    out = B.realism_verdicts(B.cost_scenarios(c.d(), c.scores(), MODELS, TOP), _rebalance(c))
    return _r(out, "no_cost_return", "base_cost_return", "daily_turnover", "weekly_turnover")


# --- I


def data_quality(c: Case) -> DataFrame:
    universe, bars = _asked_and_came(c)
    return Q.data_quality(universe, demo.valuation(c.spark, c.dir), bars, universe, T.failed_tickers(universe, bars))


def _momentum_value(c: Case) -> DataFrame:
    return X.momentum(c.wi()).withColumnRenamed("momentum", "value")


def factor_alignment(c: Case) -> DataFrame:
    bars = c.w()
    off = _momentum_value(c).withColumn("date", F.date_add("date", 1))
    out = Q.factor_alignment(_momentum_value(c), bars).withColumn("factor", F.lit("momentum")).unionByName(Q.factor_alignment(off, bars).withColumn("factor", F.lit("shifted")))
    return _r(out, "missing_ratio")


def factor_readiness(c: Case) -> DataFrame:
    return Q.factor_readiness(_momentum_value(c), c.w())


def lookahead_check(c: Case) -> DataFrame:
    return Q.lookahead_check(c.w(), X.momentum, "momentum", F.lit(demo.CUT).cast("date"), 60)


def _cuts(c: Case) -> DataFrame:
    return c.spark.createDataFrame([(d,) for d in demo.CUTS], "cut string")


def _leak(bars: DataFrame) -> DataFrame:
    """A planted leak: the close five positions ahead."""
    return X.momentum(bars, -5)


def lookahead_checks(c: Case) -> DataFrame:
    """Momentum and the planted leak against several cuts."""
    checks = [Q.lookahead_checks(c.wi(), f, "momentum", _cuts(c), 60).withColumn("factor", F.lit(name)) for name, f in (("momentum", X.momentum), ("leak", _leak))]
    return checks[0].unionByName(checks[1])


def latest_reads(c: Case) -> DataFrame:
    """Of both factors: values by the cut that they had read."""
    reads = [Q.latest_reads(c.wi(), f, "momentum", _cuts(c)).withColumn("factor", F.lit(name)) for name, f in (("momentum", X.momentum), ("leak", _leak))]
    return reads[0].unionByName(reads[1]).groupBy("factor", "latest_read", "leaks").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def snapshot_limitation(c: Case) -> DataFrame:
    v = demo.valuation(c.spark, c.dir)
    dated = v.withColumn("date", F.lit(demo.AS_OF).cast("date"))
    return Q.snapshot_limitation(v).withColumn("panel", F.lit("snapshot")).unionByName(Q.snapshot_limitation(dated).withColumn("panel", F.lit("dated")))


def _shapes(c: Case) -> DataFrame:
    pv, val = c.pv(True), c.val()
    return Q.artifact_shapes({"ohlcv": c.w(), "factors_price_volume": pv, "factors_valuation_snapshot": val, "factors_composite": X.composite_frame(pv, val)})


QUERIES: dict[str, Callable[[Case], DataFrame]] = {
    "format_bars": format_bars,
    "failed_tickers": failed_tickers,
    "select_tickers": select_tickers,
    "manifest": manifest,
    "manifest_upsert": manifest_upsert,
    "manifest_append": manifest_append,
    "parquet_round_trip": parquet_round_trip,
    "landed_json": landed_json,
    "landed_array": landed_array,
    "date_forms": date_forms,
    "numeric_suffixes": numeric_suffixes,
    "close_only_factors": close_only_factors,
    "clean_ticker": clean_ticker,
    "suffix_ticker": suffix_ticker,
    "numeric_coerce": numeric_coerce,
    "date_coerce": date_coerce,
    "normalize_universe": lambda c: T.normalize_universe(demo.raw_universe(c.spark, c.dir)),
    "normalize_valuation": lambda c: T.normalize_valuation(demo.raw_valuation(c.spark, c.dir)),
    "normalize_ohlcv": normalize_ohlcv,
    "duplicate_keys": duplicate_keys,
    "dense_grid": dense_grid,
    "field_matrix": field_matrix,
    "unpivot_factor": unpivot_factor,
    "field_blocks": field_blocks,
    "field_blocks_long": field_blocks_long,
    "line_price_ranks": line_price_ranks,
    "rank_factor_spread": lambda c: _ranked(c, S.LOWER, True),
    "rank_ic_spread": lambda c: _r(A.rank_ic(c.factors(), c.fwd(), True), "ic"),
    "factor_quantiles_spread": lambda c: _r(A.factor_quantiles(c.factors(), spread=True), "factor_value"),
    "ranked_scores_spread": lambda c: _r(G.ranked_scores(c.scores(), spread=True), "factor_score"),
    "momentum": lambda c: _r(X.momentum(c.wi()), "momentum"),
    "return_volatility": lambda c: _r(X.return_volatility(c.wi()), "return_volatility"),
    "atr_over_close": lambda c: _r(X.atr_over_close(c.wi()), "atr_over_close"),
    "low_volatility_method": low_volatility_method,
    "volume_ratio": lambda c: _r(X.volume_ratio(c.wi()), "volume_ratio"),
    "price_volume_factors": lambda c: _r(c.pv(), *FACTORS),
    "rank_factor_high": lambda c: _ranked(c, S.HIGHER),
    "rank_factor_low": lambda c: _ranked(c, S.LOWER),
    "valuation_factors": lambda c: _r(c.val(), "pb_inverse", "pe_inverse", "dividend_yield"),
    "historical_composite": lambda c: _r(X.historical_composite(c.pv()), "composite_score"),
    "mixed_composite": lambda c: _r(X.mixed_composite(c.pv(True), c.val()), "composite_score"),
    "composite_frame": lambda c: _r(c.composite(), "composite_score"),
    "historical_factors": lambda c: _r(A.historical_factors(c.pv(True), X.historical_composite(c.pv(True))), "value"),
    "forward_returns": lambda c: _r(c.fwd(), "forward_return"),
    "rank_ic": lambda c: _r(c.ic(), "ic"),
    "ic_summary": lambda c: _r(A.ic_summary(c.ic()), "ic_mean", "ic_std", "average_asset_count", "ir"),
    "factor_quantiles": lambda c: _r(c.quantiles(), "factor_value"),
    "quantile_returns": lambda c: _r(c.qr(), "mean_return"),
    "quantile_pivot": quantile_pivot,
    "bucket_turnover": lambda c: _r(A.bucket_turnover(c.quantiles(True)), "average_best_bucket_turnover"),
    "monotonicity": lambda c: _r(A.monotonicity(c.qr()), "adjacent_agreement_ratio", "top_bottom_spread"),
    "best_ic": lambda c: _r(R.best_ic(A.ic_summary(c.ic())), "ic_mean", "ic_std", "ir"),
    "maxmin_spread": lambda c: _r(R.maxmin_spread(c.qr()), "top_bottom_spread"),
    "factor_scoreboard": factor_scoreboard,
    "eligible_factors": lambda c: R.eligible_factors(c.board()),
    "readiness": lambda c: R.readiness(c.d(), 20),
    "selected_factor_scores": lambda c: _r(R.selected_factor_scores(c.composite()), "composite_score"),
    "topn_positions": lambda c: _positions(c.positions()),
    "topn_scheduled": lambda c: _positions(c.positions([("run", TOP, "weekly", False, 30)], scheduled=True)),
    "topn_buffered": lambda c: _positions(c.positions([("run", TOP, "daily", True, BUFFER)])),
    "equal_weights": lambda c: _r(c.weights().drop("scenario"), "target_weight"),
    "calendar_daily": lambda c: G.rebalance_calendar(c.d(), "daily"),
    "calendar_weekly": lambda c: G.rebalance_calendar(c.d(), "weekly"),
    "calendar_monthly": lambda c: G.rebalance_calendar(c.d(), "monthly", 2),
    "cost_model": cost_model,
    "aligned_weights": aligned_weights,
    "asset_returns_unfilled": lambda c: _r(B.asset_returns(c.d(), "none").drop("date_idx"), "ret"),
    "weights_next_trading_day": weights_next_trading_day,
    "backtest_held": backtest_held,
    "asset_returns": lambda c: _r(B.asset_returns(c.d()).drop("date_idx"), "ret"),
    "gross_returns": lambda c: _per_date(c, B.gross_returns(c.aligned(), B.asset_returns(c.d())), "gross"),
    "turnover_daily": lambda c: _per_date(c, B.turnover_daily(c.aligned()), "buy", "sell"),
    "net_returns": lambda c: _r(B.net_returns(B.daily_sums(c.d(), c.weights(), c.grid()), B.cost_scenarios_df(c.spark, MODELS)).select("date", "cost", "cost_returns", "returns"), "cost_returns", "returns"),
    "equity_curve": lambda c: backtest_results(c).select("date", "equity", "drawdown", "exposure"),
    "backtest_results": backtest_results,
    "backtest_metrics": backtest_metrics,
    "cost_scenarios": cost_scenarios,
    "topn_sensitivity": topn_sensitivity,
    "rebalance_sensitivity": rebalance_sensitivity,
    "turnover_diagnostics": lambda c: _r(B.turnover_diagnostics(c.weights(True), B.CostModel()), "value"),
    "realism_verdicts": realism_verdicts,
    "missing_ratio_columns": lambda c: Q.missing_ratio_columns(c.pv()),
    "missing_ratio_overall": lambda c: _r(Q.missing_ratio_overall(c.pv()), "missing_ratio"),
    "date_range": lambda c: Q.date_range(c.w()),
    "data_quality": data_quality,
    "factor_alignment": factor_alignment,
    "factor_readiness": factor_readiness,
    "lookahead_check": lookahead_check,
    "lookahead_checks": lookahead_checks,
    "latest_reads": latest_reads,
    "snapshot_limitation": snapshot_limitation,
    "composite_breakdown": lambda c: Q.composite_breakdown(c.composite()),
    "artifact_shapes": _shapes,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel to equity curve: factors, composite, Top-N, weights, costs."""
    return backtest_results(Case(spark, sf_dir))


#: Queries that also run on the panel of suppliers, whose number of tickers grows with the tables.
BY_SUPPLIER = [
    "dense_grid", "field_blocks", "field_blocks_long", "momentum", "return_volatility", "atr_over_close", "volume_ratio", "price_volume_factors", "close_only_factors", "historical_composite", "forward_returns", "rank_ic", "ic_summary",
    "factor_quantiles", "quantile_returns", "bucket_turnover", "monotonicity", "topn_positions", "topn_buffered", "equal_weights", "asset_returns", "asset_returns_unfilled", "backtest_results", "backtest_metrics", "backtest_held", "cost_scenarios",
    "topn_sensitivity", "rebalance_sensitivity",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(make: Callable[[Case], DataFrame], bars=None) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: make(Case(spark, sf_dir, bars))

    return {name: bind(make) for name, make in QUERIES.items()} | {f"{name}_by_supplier": bind(QUERIES[name], demo.bars_s) for name in BY_SUPPLIER}


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | oracle.statements_by_supplier(BY_SUPPLIER)
