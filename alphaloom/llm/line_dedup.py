"""Line dedup with two Bloom filters: one of keys seen once, one of keys seen twice.

A line's key is the line without white space at its ends, ASCII letters lower-cased. A key of MIN_CHARS or more
code points that several documents hold loses all its lines but those of the document with the smallest id.

Filters. Keys are hashed to 64 bits and the hashes cut into segments of about SEGMENT_KEYS each. Tasks count a hash once
per document, put what they meet twice themselves aside, and send hashes (not lines) to their segment. There each hash
goes into the first filter; one whose bits are all set already goes into the second, too. So every
key of two documents is in the second filter, with some of one document that share its bits (below 1 in 100,000).

Confirmation. Only lines whose key is in the second filter leave their task, with their text: a
minimum and a maximum of ids per key tells those that several documents hold, exactly, and which one comes first. Texts
are joined once, to the numbers of the lines that they lose.

The second filter is broadcast while it has no more than BROADCAST_BYTES. Beyond that hashes are sent to the segments'
filters instead, a segment's filter being copied for each PART_ROWS hashes it is asked about, so that a line that a third of all documents
hold is no task's burden; both ways end in the same confirmation.

Defined cases: a null or empty text is one empty line, and a null text stays null; documents are told apart by doc_id, so
rows that share one are one document, and a null id is one document that comes after all others; repeated rows
are treated alike; other columns pass through, but for n_lines and n_dropped, which are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from alphaloom.llm.common import prepare, table, written

MIN_CHARS = 10
#: Keys of a segment, and bits and hash functions of its filters.
SEGMENT_KEYS, SEGMENT_BITS, HASHES = 1 << 18, 1 << 22, 4
#: Size of a second filter that may be broadcast; hashes that one copy of a segment's filter is asked about beyond that.
BROADCAST_BYTES, PART_ROWS = 64 << 20, 4_000_000
#: Hashes that a task holds before it sends them on.
_HELD = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _keys(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line that is long enough."""
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(_BLANK)
        if len(key) >= 4 * MIN_CHARS or (len(key) >= MIN_CHARS and len(key.decode()) >= MIN_CHARS):
            yield at, key.translate(_LOWER)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    for row in range(batch.num_rows):
        text = batch.column(column)[row].as_py()
        if text:
            yield row, text.encode()


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash in its segment's filters: multiples of an odd step from a start."""
    x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    start, step = x >> np.uint64(40), (x & np.uint64(0xFFFFFF)) | np.uint64(1)
    return ((start[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _hashed(segments: int):
    """A task: doc_id, text to segment, hashes met once here, hashes met twice here, and how many there were."""

    def send(held: list[np.ndarray]):
        hashes, count = np.unique(np.concatenate(held), return_counts=True)
        where = _segment(hashes, segments).astype(np.int64)
        cuts = np.flatnonzero(np.diff(where, prepend=-1))
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)]):
            twice = count[a:b] > 1
            out.append((int(where[a]), hashes[a:b][~twice].tobytes(), hashes[a:b][twice].tobytes(), int(count[a:b].sum())))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], ["segment", "once", "twice", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            seen: dict[int | None, set[int]] = {}
            ids = batch.column(0).to_pylist()
            for row, text in _rows(batch, 1):
                seen.setdefault(ids[row], set()).update(xxhash.xxh3_64_intdigest(key) for _, key in _keys(text))
            held += [np.fromiter(s, np.uint64, len(s)) for s in seen.values() if s]
            size += sum(map(len, seen.values()))
            if size > _HELD:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return run


def _second_filters(batches):
    """Rows (segment, once, twice, n), sorted by segment, to each segment's second filter and the number of its hashes."""
    now, asked = None, 0
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary()), pa.array([asked], pa.int64())], ["segment", "bits", "asked"])

    for batch in batches:
        for segment, single, double, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if segment != now:
                if now is not None:
                    yield done()
                now, asked = segment, 0
                once[:], twice[:] = False, False
            bits = _bits(np.frombuffer(single, np.uint64))
            twice[bits[once[bits].all(axis=1)]] = True
            once[bits] = True
            bits = _bits(np.frombuffer(double, np.uint64))
            once[bits] = twice[bits] = True
            asked += n
    if now is not None:
        yield done()


def _met(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Are all of a hash's places set in packed ``bits``?"""
    return ((bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)


_SUSPECTS = "doc_id long, mark long, key string, at array<int>"


def _suspects(chosen):
    """A task: rows (doc_id, mark, text, ...) to each suspect key of a text with the numbers of its lines; ``chosen`` tells which of a batch's hashes are suspect."""

    def run(batches):
        for batch in batches:
            rows, numbers, keys = [], [], []
            for row, text in _rows(batch, 2):
                for at, key in _keys(text):
                    rows.append(row), numbers.append(at), keys.append(key)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            lines: dict[tuple[int, bytes], list[int]] = {}
            for k in np.flatnonzero(chosen(batch, np.array(rows, np.int64), hashes)).tolist():
                lines.setdefault((rows[k], keys[k]), []).append(numbers[k])
            at = pa.array([r for r, _ in lines], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for _, k in lines], pa.binary()).cast(pa.string()), pa.array(list(lines.values()), pa.list_(pa.int32()))], ["doc_id", "mark", "key", "at"])

    return run


def _by_broadcast(spark: SparkSession, texts: DataFrame, filters: DataFrame, segments: int) -> DataFrame:
    """Suspects by the whole second filter in every task."""
    table_ = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in filters.select("segment", "bits").toLocalIterator():
        table_[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(table_.ravel())

    def chosen(batch, rows, hashes):
        return _met(sent.value, (_segment(hashes, segments).astype(np.int64) * SEGMENT_BITS)[:, None] + _bits(hashes))

    out = written(spark, texts.mapInArrow(_suspects(chosen), _SUSPECTS), "suspects")
    sent.destroy()
    return out


def _by_shuffle(spark: SparkSession, texts: DataFrame, filters: DataFrame, segments: int) -> DataFrame:
    """Suspects by sending hashes to the segments' filters, and what those say back to the texts."""

    def spread(batches):
        for batch in batches:
            rows, hashes = [], []
            for row, text in _rows(batch, 2):
                own = {xxhash.xxh3_64_intdigest(key) for _, key in _keys(text)}
                rows += [row] * len(own)
                hashes += own
            at, h = pa.array(rows, pa.int64()), np.array(hashes, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_segment(h, segments).astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(h.view(np.int64))], ["segment", "doc_id", "mark", "hash"])

    def asked(batches):
        bits = np.zeros(0, np.uint8)
        for batch in batches:
            sides = np.asarray(batch.column(2))
            cuts = np.unique(np.append(np.flatnonzero(sides == 0), [0, len(sides)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if sides[a] == 0:  # a filter, in front of the hashes that ask it
                    bits = np.frombuffer(batch.column(6)[a].as_py(), np.uint8)
                    a += 1
                part = batch.slice(a, b - a)
                yes = _met(bits, _bits(np.asarray(part.column(5)).view(np.uint64))) if a < b else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(yes)) for i in (3, 4, 5)], ["doc_id", "mark", "hash"])

    parts = F.greatest(F.ceil(F.col("asked") / PART_ROWS).cast("int"), F.lit(1))
    many = filters.select("segment", parts.alias("parts")).where("parts > 1")
    # at most a row for each PART_ROWS lines
    hashes = texts.mapInArrow(spread, "segment long, doc_id long, mark long, hash long").join(F.broadcast(many), "segment", "left")
    part = F.coalesce(F.expr("cast(pmod(xxhash64(doc_id, mark), parts) as int)"), F.lit(0))
    hashes = hashes.select("segment", part.alias("part"), F.lit(1).alias("side"), "doc_id", "mark", "hash", F.lit(None).cast("binary").alias("bits"))
    none = F.lit(None).cast("long")
    copies = filters.select("segment", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"), none.alias("doc_id"), none.alias("mark"), none.alias("hash"), "bits")
    met = copies.unionByName(hashes).repartition("segment", "part").sortWithinPartitions("segment", "part", "side").mapInArrow(asked, "doc_id long, mark long, hash long")
    own = met.groupBy("doc_id", "mark").agg(F.collect_set("hash").alias("hashes"))
    told = texts.alias("t").join(own.alias("o"), _same("t", "o")).select("t.doc_id", "t.mark", "t.text", "o.hashes")

    def chosen(batch, rows, hashes):
        lists = batch.column(3).to_pylist()
        sets: dict[int, set[int]] = {}
        return np.array([h in sets.setdefault(r, set(lists[r])) for r, h in zip(rows.tolist(), hashes.view(np.int64).tolist())], bool)

    return written(spark, told.mapInArrow(_suspects(chosen), _SUSPECTS), "suspects")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.mark").eqNullSafe(F.col(f"{b}.mark"))


def _place() -> Column:
    """What documents are ordered by: ids, then the nameless one."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, numbers):
        lost = set() if gone is None else set(gone.tolist())
        out.append(None if gone is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost))
    return pd.Series(out, dtype=object)


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with texts that lost their repeated lines, and the columns n_lines (before that) and n_dropped."""
    prepare(spark)
    text = F.col("text").cast("string")
    mark = F.xxhash64(text, F.length(text))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), text.alias("text"))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(n_lines)).first()[0] or 0
    segments = max(1, -(-total // SEGMENT_KEYS))
    sent = texts.select("doc_id", "text").mapInArrow(_hashed(segments), "segment long, once binary, twice binary, n long")
    sent = sent.repartition(min(segments, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "segment").sortWithinPartitions("segment")
    filters = written(spark, sent.mapInArrow(_second_filters, "segment long, bits binary, asked long"), "filters")
    way = _by_broadcast if segments * SEGMENT_BITS // 8 <= BROADCAST_BYTES else _by_shuffle
    suspects = way(spark, texts, filters, segments)

    held = suspects.groupBy("key").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    repeats = written(spark, held.where(~F.col("first").eqNullSafe(F.col("last"))).select("key", "first"), "repeats")
    lost = suspects.join(repeats.hint("merge"), "key").where(~_place().eqNullSafe(F.col("first"))).select("doc_id", "mark", "at")
    gone = lost.groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("at")).alias("at"))

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), n_lines.alias("n_lines"))
    both = whole.alias("w").join(gone.alias("g"), _same("w", "g"), "left")
    at = F.col("g.at")
    kept = F.when(at.isNull(), F.col("w.d.text")).otherwise(_without(F.when(at.isNotNull(), F.col("w.d.text").cast("string")), at))
    columns = [kept.alias("text") if c == "text" else F.col("w.d").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*columns, F.col("w.n_lines").alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
