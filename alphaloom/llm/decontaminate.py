"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

Items are cut into windows of WINDOW consecutive words (a shorter item is one window). A document
contains a window exactly, or not at all, so the necessary prefix of a window, with its words ordered
by rarity, is a single word: its rarest one, by counts over all documents. A document word that is
nobody's prefix is dropped by one bit-table lookup. For the others the position gives where the
window would have to start and end (positional and length bound: inside the document), and what is
left is verified word by word at that place. Only then is a word "hit".

Up to BLOCK_WINDOWS windows, the usual case, are broadcast: one pass counts, one joins, and no text is
shuffled. More windows are joined by key, again with one pass that counts and one that reads texts, however many there
are: words that no window begins its prefix with are dropped by a bit table of fixed size, and the others go to
the windows of their prefix with the WINDOW - 1 words on both sides of them, which is all that the check needs. A common
prefix is a skewed key of a join whose other side is written, so it can be split.

Windows travel as numbers, without the items that have them, so a window that a third of all items share takes
no more room in a block than any other. Items are joined by number, once for each distinct set of windows
that a document has: documents with the same passage share one list of items.

Defined cases: a null or empty text, of a document or an item, has no words; an item without words
has no window; repeated items count as often as they have distinct ids; repeated document rows are
judged each by itself; a null item_id is ignored; a null doc_id is judged and returned like any other
row; other columns are ignored; an empty benchmark hits nothing; an empty table of documents gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import keyed, prepare, row_key, table, text_bytes, written
from alphaloom.llm.words import U, split_words

WINDOW = 13
#: A document is contaminated if it has a hit and hits make up one word in this many.
ONE_IN = 20
#: Windows that may be broadcast; bits of the table that tells prefixes beyond that, and bytes of its pieces.
BLOCK_WINDOWS = 100_000
PREFIX_BITS, _PIECE = 27, 1 << 16


def _split(column):
    data, offsets = text_bytes(column)
    return split_words(data, offsets, "alnum", lower=True)


def _item_windows(batches):
    """item_id and the word hashes of each of its windows."""
    for batch in batches:
        words = _split(batch.column(1))
        items, rows = [], []
        for item, a, b in zip(batch.column(0).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist()):
            size = min(WINDOW, b - a)
            for s in range(a, b - size + 1) if size else ():
                items.append(item)
                rows.append(words.hashes[s : s + size].astype(np.int64))
        sizes = np.array([len(r) for r in rows], np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))], ["item_id", "words"])


class _Lookup:
    """Membership of many 64-bit hashes: a bit table first, a sorted search for what passes."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.keys >> U(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are keys, and the number of the key."""
        at = np.flatnonzero(self.table[(hashes >> U(64 - self.BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[key] == hashes[at]
        return at[good], key[good]


class _Block:
    """Windows that are broadcast, keyed by the place of their rarest word."""

    def __init__(self, windows: list[list[int]], numbers: list[int], counts: dict[int, int]):
        size = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), WINDOW), U)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = np.array(w, np.int64).astype(U)
        place = np.array([min(range(len(w)), key=lambda j: (counts.get(w[j], 0), w[j])) for w in windows], np.int64)
        prefix = self.words[np.arange(len(windows)), place]
        order = np.argsort(prefix, kind="stable")
        self.words, self.size, self.place = self.words[order], size[order], place[order]
        self.lookup = _Lookup(prefix)
        self.begin = np.searchsorted(prefix[order], self.lookup.keys)
        self.end = np.searchsorted(prefix[order], self.lookup.keys, "right")
        self.numbers = np.array(numbers, np.int64)[order]

    def match(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each occurrence of a window, and the number of the window."""
        at, key = self.lookup.find(hashes)
        many = self.end[key] - self.begin[key]
        where = np.repeat(at, many)
        window = np.repeat(self.begin[key], many) + np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        start = where - self.place[window]
        doc = np.searchsorted(first, where, "right") - 1
        good = (start >= first[doc]) & (start + self.size[window] <= first[doc + 1])
        start, window = start[good], window[good]
        for j in range(WINDOW):
            far = self.size[window] <= j
            same = far | (hashes[np.where(far, start, start + j)] == self.words[window, j])
            start, window = start[same], window[same]
        return start, window


def _counter(block):
    def count(batches):
        look = block.value
        total = np.zeros(len(look.keys), np.int64)
        for batch in batches:
            _, key = look.find(_split(batch.column(0)).hashes)
            total += np.bincount(key, minlength=len(total))
        use = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(look.keys[use].astype(np.int64)), pa.array(total[use])], ["word", "n"])

    return count


def _joiner(block):
    def join(batches):
        own = block.value
        for batch in batches:
            words = _split(batch.column(2))
            start, window = own.match(words.hashes, words.first)
            depth = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + own.size[window], -1)
            hit = np.cumsum(depth) > 0
            hit[-1] = False
            edge = hit.copy()
            edge[1:] &= ~hit[:-1]
            inner = words.first[1:-1]
            edge[inner] = hit[inner]
            low = np.flatnonzero(edge)
            stop = hit[:-1] & ~hit[1:]
            stop[inner[inner > 0] - 1] = hit[inner[inner > 0] - 1]
            high = np.flatnonzero(stop) + 1
            bounds = np.searchsorted(low, words.first)
            doc = np.searchsorted(words.first, low, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array((low - words.first[doc]).astype(np.int32)), pa.array((high - words.first[doc]).astype(np.int32))], ["first", "stop"])
            owner = np.searchsorted(words.first, start, "right") - 1
            pair = np.lexsort((own.numbers[window], owner))
            owner, number = owner[pair], own.numbers[window[pair]]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
            found = np.searchsorted(owner[fresh], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans), pa.ListArray.from_arrays(pa.array(found), pa.array(number[fresh]))],
                ["doc_id", "row", "n_words", "spans", "windows"],
            )

    return join


_SHAPE = "doc_id long, row long, n_words long, spans array<struct<first:int,stop:int>>, windows array<long>"


def _windows_of(spark: SparkSession, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows, each with a number, and the numbers with the ids of their items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    pairs = items.mapInArrow(_item_windows, "item_id long, words array<long>")
    windows = written(spark, pairs.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, pairs.join(windows, "words").select("window", "item_id").distinct()


def _block(spark: SparkSession, texts: DataFrame, windows: DataFrame) -> _Block:
    """Windows to broadcast, ordered by the counts of their words over all texts."""
    rows = windows.select("words", "window").collect()
    counts = []
    if rows:
        look = spark.sparkContext.broadcast(_Lookup(np.unique(np.array([w for r in rows for w in r["words"]], np.int64).astype(U))))
        counts = texts.select("text").mapInArrow(_counter(look), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        look.destroy()
    return _Block([r["words"] for r in rows], [r["window"] for r in rows], {r["word"]: r["n"] for r in counts})


def _judged(spark: SparkSession, hits: DataFrame, members: DataFrame) -> DataFrame:
    hits = written(spark, hits, "hits")
    some, none = hits.where(F.size("windows") > 0), hits.where(F.size("windows") == 0)
    sets = some.select("windows").distinct()
    listed = sets.withColumn("window", F.explode("windows")).join(members, "window").groupBy("windows").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    # written, so that the join can split a set of windows that many documents have; documents without a hit join nothing
    out = some.join(written(spark, listed, "listed"), "windows").unionByName(none.withColumn("items", F.array().cast("array<long>")))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    # spans of several windows overlap: walk them in order and count only what lies beyond the furthest word so far
    walked = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("far")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["first"], s["far"]))).alias("n"), F.greatest(s["far"], x["stop"]).alias("far")))["n"]
    out = out.withColumn("n_hit", walked.cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), _bad(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "spans", "items", "row")


def _bad(hit, words):
    return (hit > 0) & (ONE_IN * hit >= words)


def _word_counts(batches):
    for batch in batches:
        word, n = np.unique(_split(batch.column(0)).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])


def _bit_table(spark: SparkSession, prefixes: DataFrame) -> np.ndarray:
    """A bit for each prefix's leading PREFIX_BITS, packed: tasks make tables, whose pieces are united by number."""

    def own(batches):
        bits = np.zeros((1 << PREFIX_BITS) // 8, np.uint8)
        for batch in batches:
            at = (np.asarray(batch.column(0)).astype(U) >> U(64 - PREFIX_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        pieces = bits.reshape(-1, _PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pieces[k].tobytes() for k in some.tolist()], pa.binary())], ["piece", "bits"])

    def united(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = np.frombuffer(raw, np.uint8)
                out[piece] = bits | out[piece] if piece in out else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([b.tobytes() for b in out.values()], pa.binary())], ["piece", "bits"])

    table = np.zeros(((1 << PREFIX_BITS) // 8 // _PIECE, _PIECE), np.uint8)
    shape = "piece int, bits binary"
    for r in prefixes.mapInArrow(own, shape).repartition("piece").mapInArrow(united, shape).collect():  # a table's pieces, once each
        table[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _candidates(table):
    """doc_id, row, text to doc_id, row, n_words and the words that may be prefixes, with what stands around them."""
    reach = np.arange(1 - WINDOW, WINDOW)

    def run(batches):
        bits = table.value
        for batch in batches:
            words = _split(batch.column(2))
            code = (words.hashes >> U(64 - PREFIX_BITS)).astype(np.int64)
            at = np.flatnonzero((bits[code >> 3] >> (code & 7).astype(np.uint8)) & 1)
            doc = np.searchsorted(words.first, at, "right") - 1
            near = at[:, None] + reach
            inside = (near >= words.first[doc][:, None]) & (near < words.first[doc + 1][:, None])
            around = np.where(inside, words.hashes[np.where(inside, near, at[:, None])], U(0)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * len(reach)).astype(np.int32)), pa.array(around.ravel()))
            found = pa.StructArray.from_arrays([pa.array(words.hashes[at].astype(np.int64)), pa.array((at - words.first[doc]).astype(np.int32)), lists], ["word", "at", "around"])
            cuts = np.searchsorted(at, words.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(cuts), found)], ["doc_id", "row", "n_words", "found"])

    return run


def _by_key(spark: SparkSession, texts: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits of any number of windows: counts, then a join of prefixes with the words of texts."""
    counts = texts.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = windows.select("window", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
    rarest = words.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("p"))
    own = written(spark, windows.join(rarest, "window").select("window", "words", F.col("p.word").alias("word"), F.col("p.place").alias("place")), "prefixes")
    table = spark.sparkContext.broadcast(_bit_table(spark, own.select("word")))
    some = written(spark, texts.mapInArrow(_candidates(table), "doc_id long, row long, n_words long, found array<struct<word:long,at:int,around:array<long>>>"), "candidates")
    table.destroy()
    near = some.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    first, stop = F.col("at") - F.col("place"), F.col("at") - F.col("place") + F.size("words")
    fits = (first >= 0) & (stop <= F.col("n_words")) & (F.slice("around", WINDOW - F.col("place"), F.size("words")) == F.col("words"))
    met = near.join(own.hint("merge"), "word").where(fits).groupBy("row").agg(F.collect_list(F.struct(first.alias("first"), stop.alias("stop"))).alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    none = F.array()
    out = some.select("doc_id", "row", "n_words").join(met, "row", "left")
    return out.select("doc_id", "row", "n_words", F.coalesce("spans", none.cast("array<struct<first:int,stop:int>>")).alias("spans"), F.coalesce("windows", none.cast("array<long>")).alias("windows"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and items themselves, and row, which is column ``key`` if one is given."""
    prepare(spark)
    windows, members = _windows_of(spark, benchmark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(key).alias("row"), F.col("text").cast("string").alias("text"))
    if windows.count() <= BLOCK_WINDOWS:
        block = spark.sparkContext.broadcast(_block(spark, texts, windows))
        return _judged(spark, texts.mapInArrow(_joiner(block), _SHAPE), members)
    return _judged(spark, _by_key(spark, texts, windows), members)


def _cleaner(block, text: int):
    def clean(batches):
        join = _joiner(block)
        for batch in batches:
            key = pa.nulls(batch.num_rows, pa.int64())
            judged = next(join([pa.RecordBatch.from_arrays([key, key, batch.column(text)], ["doc_id", "row", "text"])]))
            spans = judged.column(3)
            flat = spans.flatten()
            sums = np.append(0, np.cumsum(np.asarray(flat.field(1)).astype(np.int64) - np.asarray(flat.field(0))))
            hit = np.diff(sums[np.asarray(spans.offsets)])
            yield batch.filter(pa.array(~_bad(hit, np.asarray(judged.column(2)))))

    return clean


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns; up to BLOCK_WINDOWS windows they pass by and nothing is joined."""
    prepare(spark)
    windows, _ = _windows_of(spark, benchmark)
    if windows.count() <= BLOCK_WINDOWS:
        block = spark.sparkContext.broadcast(_block(spark, docs.select(F.col("text").cast("string").alias("text")), windows))
        return docs.mapInArrow(_cleaner(block, docs.columns.index("text")), docs.schema)
    rows, key = keyed(spark, docs)
    bad = contamination(spark, rows, benchmark, key).where("contaminated").select(F.col("row").alias(key))
    return rows.join(bad, key, "left_anti").select(docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items", "row")
