"""Files that hold one JSON array of objects each, read in splits: one array of any length is many tasks.

Spark's text reader cuts files at "}", so its splits lie anywhere and no record is read by one task alone because of
its file. What a cut means depends on what came before it: it may lie within a string, or close an inner object.
So a first pass sums up each split for both cases, beginning outside or inside of a string: parity of its quotes, change of depth,
lowest depth. A scan over those rows (one per split, some hundred MB of text) tells how each split really begins. The second
pass gives the records, and pieces of those that cross an edge of splits, which are put together by where they began.
Records become JSON lines in the shared folder and are parsed by Spark.

An array that does not begin or end, text between records, an unfinished record, or a record that Spark can't parse is an
error, and so is a payload without records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.sources.scratch import scratch

_SPLIT = "file string, start long, odd boolean, change array<long>, least array<long>, opens boolean, closes boolean"


def _piece_functions():
    """Functions that executors get by value: what a piece does, and a pass of either kind over sorted splits' pieces."""
    import re

    escaped = re.compile(r"\\.", re.S)
    end = re.compile(r"\s*\]\s*")

    def effect(piece: str, inside: int) -> tuple[int, int]:
        """Objects that a piece opens, and whether it ends within a string, if it begins so or not."""
        if "\\" in piece:
            piece = escaped.sub("", piece)
        if '"' not in piece:
            return (0 if inside else piece.count("{")), inside
        parts = piece.split('"')
        return sum(x.count("{") for x in parts[inside::2]), (inside + len(parts) - 1) % 2

    def summary(batches):
        rows: dict[tuple[str, int], list] = {}
        for batch in batches:
            for piece, file, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = rows.get((file, start))
                if row is None:
                    first = piece.lstrip("﻿ \t\r\n")
                    row = rows[file, start] = [0, 1, [0, 0], [0, 0], start == 0 and first[:1] == "[", ""]
                for case in (0, 1):
                    opens, row[case] = effect(piece, row[case])
                    row[2][case] += opens - (1 - row[case])
                    row[3][case] = min(row[3][case], row[2][case])
                row[5] = piece
        out = [(f, s, r[0] == 1, r[2], r[3], r[4], bool(end.fullmatch(r[5].lstrip("﻿ \t\r\n").removeprefix("[") if s == 0 else r[5]))) for (f, s), r in rows.items()]
        yield pa.RecordBatch.from_pydict(
            {k: [r[i] for r in out] for i, k in enumerate(("file", "start", "odd", "change", "least", "opens", "closes"))},
            schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("change", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("opens", pa.bool_()), ("closes", pa.bool_())]),
        )

    def records(begins, extra):
        """Pieces to (text, file, origin, start, extra columns); origin is null for a record of one split."""

        def run(batches):
            state: dict[tuple[str, int], list] = {}
            shape = None
            for batch in batches:
                shape = batch.schema
                out, constants = [], []
                more = [batch.column(3 + i).to_pylist() for i in range(extra)]
                for row, (piece, file, start) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                    key = (file, start)
                    now = state.get(key)
                    if now is None:
                        inside, depth, origin, _ = begins[file, start]
                        # inside, depth, text so far, where its record began, the piece before, which is not the file's last one
                        now = state[key] = [inside, depth, [], origin if depth or inside else None, None, None]
                    before, now[4] = now[4], piece
                    now[5] = [m[row] for m in more]
                    if before is not None:
                        step(now, before, key, out, constants)
                yield rows(out, constants, shape)
            out, constants = [], []
            for key, now in state.items():
                if now[4] is not None and not begins[key][3]:
                    step(now, now[4], key, out, constants)
                if now[2]:
                    out.append(("".join(now[2]), key[0], key[1] if now[3] is None else now[3], key[1]))
                    constants.append(now[5])
            if out:
                yield rows(out, constants, shape)

        def step(now, piece, key, out, constants):
            if not now[2] and now[3] is None:  # between records
                piece = piece.lstrip("﻿ \t\r\n")
                if piece[:1] not in ("[", ",") or piece[1:].lstrip()[:1] != "{":
                    raise ValueError(f"Landed payload is not a JSON array of objects: {key[0]} near {piece[:40]!r}")
                piece = piece[1:]
            opens, now[0] = effect(piece, now[0])
            now[1] += opens - (1 - now[0])
            now[2].append(piece.replace("\n", " ").replace("\r", " ") + "}")
            if now[1] == 0 and not now[0]:
                out.append(("".join(now[2]), key[0], now[3], key[1]))
                constants.append(now[5])
                now[2], now[3] = [], None

        def rows(out, constants, shape):
            columns = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())]
            columns += [pa.array([c[i] for c in constants], shape.field(3 + i).type) for i in range(extra)]
            return pa.RecordBatch.from_arrays(columns, ["text", "file", "origin", "start", *(shape.field(3 + i).name for i in range(extra))])

        return run

    return summary, records


def _begins(splits: list) -> dict[tuple[str, int], tuple[int, int, int, bool]]:
    """How each split begins: within a string, at which depth, in which split that record began, and whether it is its file's last one. Files that are no arrays are errors."""
    out, at = {}, None
    ordered = sorted(splits, key=lambda r: (r["file"], r["start"]))
    for k, r in enumerate(ordered):
        last = k + 1 == len(ordered) or ordered[k + 1]["file"] != r["file"]
        if r["file"] != at:
            at, inside, depth, origin = r["file"], 0, 0, r["start"]
            if not r["opens"]:
                raise ValueError(f"Landed payload is not a JSON array: {at}")
        out[at, r["start"]] = (inside, depth, origin, last)
        if depth + r["least"][inside] <= 0:
            origin = r["start"]  # what is open at its end began in it
        depth, inside = depth + r["change"][inside], inside ^ r["odd"]
        # the end, "]", was counted as if a brace followed
        if last and not (r["closes"] and depth == -1 and not inside):
            raise ValueError(f"Landed payload does not end as a JSON array: {at}")
    return out


def read_landed_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The objects of all files below ``path``, with the columns of partition folders; the schema is inferred if none is given."""
    if not spark.read.format("binaryFile").load(path).select("length").where("length = 0").isEmpty():
        raise ValueError("Landed payload is not a JSON array")
    pieces = spark.read.option("lineSep", "}").text(path)
    folders = [f for f in pieces.schema.fields if f.name != "value"]
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), *(f.name for f in folders))
    summary, records = _piece_functions()
    begins = _begins(pieces.select("value", "_file", "_start").mapInArrow(summary, _SPLIT).collect())  # a row per split
    sent = spark.sparkContext.broadcast(begins)

    def run(batches):
        return records(sent.value, len(folders))(batches)

    names = [f.name for f in folders]
    found = pieces.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("file", T.StringType()), T.StructField("origin", T.LongType()), T.StructField("start", T.LongType()), *folders]))
    whole = found.where("origin is null").select("text", *names)
    joined = found.where("origin is not null").groupBy("file", "origin", *names).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    lines = scratch(spark, "landed")
    writer = whole.unionByName(joined.select("text", *names)).write
    (writer.partitionBy(*names) if names else writer).text(lines)
    sent.destroy()
    reader = spark.read.option("mode", "FAILFAST")
    try:
        df = (reader.schema(schema) if schema is not None else reader).json(lines)
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            raise ValueError("Landed payload has no rows") from e
        raise
    if not df.columns or df.isEmpty():
        raise ValueError("Landed payload has no rows")
    return df
