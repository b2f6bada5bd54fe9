"""Shared helpers of the training-data operators: tables, scratch space and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 1000
#: Rows of a few numbers that one task and file get.
FILE_ROWS = 200_000
#: Files whose numbers may be broadcast.
MOST_FILES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: small Arrow batches, since texts may be long, and this package shipped to them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_alphaloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="alphaloom-")) / "alphaloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._alphaloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="alphaloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(spark: SparkSession, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh Parquet table in the shared folder and read it back: the lineage ends there.

    ``rows``: about how many small rows there are, if that is known; a task then gets FILE_ROWS of them.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what was made from them is written itself."""
    for done in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(done._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, and that column's name; every reader sees the same keys.

    A table that is read from Parquet files as it is has its keys already, a file's number and the row's place in the file. Others are written once.
    """
    key = fresh(docs, "_row")
    return _placed(spark, docs, key) or written(spark, docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _placed(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame | None:
    """``docs`` with keys from its files, if it is a plain read of Parquet."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or fresh(docs, "_metadata") != "_metadata":
        return None
    file, row = fresh(docs, "_file"), fresh(docs, "_place")
    path = F.col("_metadata.file_path")
    try:
        rows = docs.select("*", F.xxhash64(path).alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return None
    paths = docs.select(path.alias("path")).distinct()
    files = written(spark, paths.select(F.xxhash64("path").alias(file)).withColumn("number", F.row_number().over(Window.orderBy(file))), "files")
    size = files.agg(F.count("*").alias("n"), F.countDistinct(file).alias("d")).first()
    if size["d"] < size["n"] or size["n"] > MOST_FILES:
        return None
    numbered = rows.join(F.broadcast(files), file)  # a few bytes a file
    return numbered.select(*(F.col(f"`{c}`") for c in docs.columns), (F.shiftleft(F.col("number").cast("long"), 40) + F.col(row)).alias(key))


def row_key(key: str | None) -> Column:
    """The key of ``keyed`` tables, if there is one, else a number made while reading."""
    return F.col(key) if key else F.monotonically_increasing_id()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes in ``column`` each, and one row at least: arrays made from a slice stay small."""
    ends = text_bytes(batch.column(column))[1]
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop
