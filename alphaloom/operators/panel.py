"""The (date, ticker) panel in long form: validation, date positions, dense grid, pivots.

Time is an integer position among the panel's dates, so that shifts and rolling windows are RANGE
frames on sparse rows. Only the distinct dates pass through one task (a calendar has some ten
thousand); bars never do. Bars that carry a column date_idx already (``with_date_idx``, written once) keep
their positions everywhere below.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.operators.ranks import spread_ranks

#: Dates and tickers of one block of a field's matrix.
BLOCK_ROWS, BLOCK_COLUMNS = 256, 256


def duplicate_keys(df: DataFrame, keys: list[str] = ["date", "ticker"]) -> DataFrame:  # noqa: B006
    """Keys that occur more than once, with the number of their rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def validate_panel(df: DataFrame, required: list[str]) -> DataFrame:
    """``df``, if it has all columns and no key twice."""
    missing = sorted({"date", "ticker", *required} - set(df.columns))
    if missing:
        raise KeyError(f"Missing required columns: {missing}")
    if not duplicate_keys(df).isEmpty():
        raise ValueError("Found duplicate date+ticker rows")
    return df


def date_index(df: DataFrame) -> DataFrame:
    """Distinct dates with their position from 1."""
    if "date_idx" in df.columns:
        return df.select("date", "date_idx").where("date is not null").distinct()
    return df.select("date").where("date is not null").distinct().withColumn("date_idx", F.row_number().over(Window.orderBy("date")))


def with_date_idx(bars: DataFrame) -> DataFrame:
    """``bars`` with date_idx; rows without a date go."""
    return bars.where("date is not null") if "date_idx" in bars.columns else bars.join(date_index(bars), "date")


def dense_grid(bars: DataFrame) -> DataFrame:
    """Every date with every ticker; values are null where there was no row. Dates travel as one array, spread out per ticker."""
    dates = date_index(bars).agg(F.array_sort(F.collect_list(F.struct("date_idx", "date"))).alias("d"))
    tickers = bars.select("ticker").where("ticker is not null").distinct()
    cells = tickers.join(F.broadcast(dates)).select("ticker", F.inline("d"))
    return cells.join(bars.drop("date_idx"), ["date", "ticker"], "left")


@dataclass(frozen=True)
class FieldBlocks:
    """A field's dates-by-tickers matrix in blocks.

    ``blocks``: row_block, column_block, n_rows, n_columns and values, row by row, null where there was no bar;
    ``dates`` (date, date_idx) and ``tickers`` (ticker, ticker_idx) name rows and columns, numbered from 1 in their order.
    """

    blocks: DataFrame
    dates: DataFrame
    tickers: DataFrame
    rows: int
    columns: int

    def to_long(self) -> DataFrame:
        """date, asset, factor for every cell, as ``unpivot_factor`` gives for a wide table."""
        cells = self.blocks.select("row_block", "column_block", "n_columns", F.posexplode("values").alias("_k", "factor"))
        row = F.col("row_block") * self.rows + F.floor(F.col("_k") / F.col("n_columns")) + 1
        column = F.col("column_block") * self.columns + F.col("_k") % F.col("n_columns") + 1
        cells = cells.select(row.cast("int").alias("date_idx"), column.cast("long").alias("ticker_idx"), "factor")
        named = cells.join(self.tickers, "ticker_idx").join(F.broadcast(self.dates), "date_idx")
        return named.select("date", F.col("ticker").alias("asset"), "factor")


def ticker_index(bars: DataFrame) -> DataFrame:
    """Distinct tickers with their position from 1, in order; their ranges are sorted by many tasks."""
    names = bars.select("ticker").where("ticker is not null").distinct().withColumn("_all", F.lit(0))
    return spread_ranks(names, ["_all"], "ticker", ties=["ticker"]).select("ticker", F.col("_position").alias("ticker_idx"))


def field_blocks(bars: DataFrame, field: str, rows: int = BLOCK_ROWS, columns: int = BLOCK_COLUMNS) -> FieldBlocks:
    """One field as a blocked matrix, for any number of tickers: a block of ``rows`` dates and ``columns`` tickers is one group of the shuffle."""
    dates, tickers = date_index(bars), ticker_index(bars)
    sizes = dates.agg(F.max("date_idx").alias("_dates")).join(tickers.agg(F.max("ticker_idx").cast("int").alias("_tickers")))
    at = with_date_idx(bars).join(tickers, "ticker").join(F.broadcast(sizes))  # one row
    row, column = F.col("date_idx") - 1, F.col("ticker_idx").cast("int") - 1
    placed = at.select(
        F.floor(row / rows).cast("int").alias("row_block"), F.floor(column / columns).cast("int").alias("column_block"), (row % rows).alias("_row"), (column % columns).alias("_column"), F.col(field).cast("double").alias("_value"),
        F.least(F.lit(rows), F.col("_dates") - F.floor(row / rows) * rows).cast("int").alias("n_rows"), F.least(F.lit(columns), F.col("_tickers") - F.floor(column / columns) * columns).cast("int").alias("n_columns"),
    )

    def block(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        n, m = first["n_rows"], first["n_columns"]
        values, there = np.zeros(n * m), np.zeros(n * m, bool)
        own = group.column("_value").combine_chunks()
        where = np.asarray(group.column("_row")) * m + np.asarray(group.column("_column"))
        values[where], there[where] = np.asarray(own.fill_null(0.0)), np.asarray(own.is_valid())
        return pa.table({"row_block": [first["row_block"]], "column_block": [first["column_block"]], "n_rows": [n], "n_columns": [m], "values": [pa.array(values, mask=~there)]}, schema=pa.schema([*((c, pa.int32()) for c in ("row_block", "column_block", "n_rows", "n_columns")), ("values", pa.list_(pa.float64()))]))

    filled = placed.groupBy("row_block", "column_block").applyInArrow(block, "row_block int, column_block int, n_rows int, n_columns int, values array<double>")
    # blocks without a bar are all null
    every = sizes.select(F.col("_dates"), F.explode(F.sequence(F.lit(0), F.floor((F.col("_tickers") - 1) / columns).cast("int"))).alias("column_block"), "_tickers")
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_dates") - 1) / rows).cast("int"))).alias("row_block"))
    shape = every.select("row_block", "column_block", F.least(F.lit(rows), F.col("_dates") - F.col("row_block") * rows).cast("int").alias("n_rows"), F.least(F.lit(columns), F.col("_tickers") - F.col("column_block") * columns).cast("int").alias("n_columns"))
    none = F.array_repeat(F.lit(None).cast("double"), F.col("n_rows") * F.col("n_columns"))
    blocks = shape.join(filled.select("row_block", "column_block", F.col("values").alias("_values")), ["row_block", "column_block"], "left").select("row_block", "column_block", "n_rows", "n_columns", F.coalesce("_values", none).alias("values"))
    return FieldBlocks(blocks, dates, tickers, rows, columns)


def field_matrix(bars: DataFrame, field: str, tickers: list[str]) -> DataFrame:
    """Wide export of one field: a row per date, a column per ticker, so as many tickers as a schema holds; ``field_blocks`` takes any number."""
    return bars.groupBy("date").pivot("ticker", sorted(tickers)).agg(F.first(field)).orderBy("date")


def unpivot_factor(wide: DataFrame, id_col: str = "date") -> DataFrame:
    """Wide to long, nulls kept: date, asset, factor."""
    return wide.unpivot(id_col, [c for c in wide.columns if c != id_col], "asset", "factor")
