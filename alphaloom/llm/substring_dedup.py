"""Substring dedup: a relative Lempel-Ziv parse of every document against the indexed blocks of all earlier ones.

A word goes when it lies in a window of WINDOW consecutive words whose sequence also starts in a
document with a smaller doc_id.

Reference blocks and their index. The rarest-looking GRAM-word run of a window (the one with the
smallest hash) is its anchor. Equal windows have equal anchors, so windows in a row that share an
anchor form a block, and the anchor is the block's index key: about one key per 20 words instead of
one per word. A block whose anchor no other document has cannot take part and ends there. Of the
others, each distinct block is in the reference once, at its first place: the smallest document that
has it, and where it begins there. Blocks that share an anchor but were first seen in different
documents differ around a shared passage, so each of their windows is in the reference, too, again
once and at its first place.

Greedy parse. A document's blocks and windows that are in the reference at an earlier document, in
order, are the places where a factor can run; where the next of them lies in the source as it lies in
the document, the run goes on. At each position the parse takes the run there to its end as one
factor, (start, length, source document, start in the source), and goes on behind it; words in no run
are literals. The reference holds everything once, so the longest factor at a position is the one run
that covers it. Factors are of WINDOW words at least; what is shorter is a literal.

Factor boundaries. A window that straddles the end of a factor can lie in the reference at another
place, where the parse does not look. Runs that begin before the last factor's end are therefore
checked, and what they cover beyond it is a duplicate span of its own. Factors and these spans together
are exactly the rule above, judged on the input.

Registration is a minimum per key (pre-aggregated before the shuffle), looked up by a join, so a
passage that a third of all documents share is no more than a skewed join key, and no pairs of
documents are formed. Keys are 128 bits wide (an anchor's and a block's hash, or two window hashes).
Neighbouring windows become runs while they stream by, so a long copied text is one run.

Defined cases: a null or empty text has no words; a text of fewer than WINDOW words keeps all;
repetition inside one document is not a duplicate; rows that share a doc_id are not "earlier" than
each other, and each keeps its own text: a row is known by its doc_id and a hash of its text, and rows
equal in both are treated alike; a row without doc_id keeps all its words and is no reference; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import prepare, table, text_bytes, written
from alphaloom.llm.words import U, run_hashes, span_hashes, split_words

WINDOW, GRAM = 50, 10
_LOW = U((1 << 24) - 1)


def _blocks(batches):
    """For each block: anchor, block hash, doc_id, first window and number of windows."""
    grams = WINDOW - GRAM + 1
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        words = split_words(data, offsets)
        first = words.first
        n = len(words.hashes)
        counts = np.maximum(np.diff(first) - WINDOW + 1, 0)
        if not counts.any():
            continue
        gram = run_hashes(words.hashes, GRAM)
        within = np.arange(n, dtype=np.int64) - np.repeat(first[:-1], np.diff(first))
        least = (gram & ~_LOW) | (within[: len(gram)].astype(U) & _LOW)
        span = 1
        while 2 * span <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if grams > span:
            least = np.minimum(least[: -(grams - span)], least[grams - span :])
        doc = np.repeat(np.arange(len(counts)), counts)
        window = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)  # within its document
        at = window + first[:-1][doc]
        anchor = at + ((least[at].astype(np.int64) - window) & int(_LOW))
        fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])))
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(doc)))
        block = span_hashes(words.hashes, at[begin], at[begin] + length + WINDOW - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[anchor[begin]].astype(np.int64)), pa.array(block.astype(np.int64)), *(batch.column(i).take(pa.array(doc[begin])) for i in (0, 2)), pa.array(window[begin].astype(np.int32)), pa.array(length.astype(np.int32))],
            ["anchor", "block", "doc_id", "content", "start", "windows"],
        )


def _windows(batches):
    """For each window of the given blocks: two hashes, the row's key and its first word."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        words = split_words(data, offsets)
        spans = batch.column(3)
        size = np.diff(np.asarray(spans.offsets))
        flat = spans.flatten()
        start, count = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
        doc = np.repeat(np.arange(len(size)), size)
        base = np.repeat(start + words.first[:-1][doc], count)
        at = base + np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)
        doc = np.repeat(doc, count)
        pair = [pa.array(span_hashes(words.hashes, at, at + WINDOW, seed).astype(np.int64)) for seed in (1, 2)]
        yield pa.RecordBatch.from_arrays([*pair, *(batch.column(i).take(pa.array(doc)) for i in (0, 2)), pa.array((at - words.first[:-1][doc]).astype(np.int32))], ["w1", "w2", "doc_id", "content", "start"])


def _runs(batches):
    """Sorted matches (doc_id, content, start, windows, source, source_start) to one row per document with its runs."""
    held = np.zeros((0, 6), np.int64)

    def rows(m: np.ndarray):
        key = np.flatnonzero(np.append(True, (m[1:, :2] != m[:-1, :2]).any(axis=1)))
        runs = pa.StructArray.from_arrays([pa.array(m[:, 2].astype(np.int32)), pa.array(m[:, 3].astype(np.int32)), pa.array(m[:, 4]), pa.array(m[:, 5].astype(np.int32))], ["start", "windows", "source", "source_start"])
        return pa.RecordBatch.from_arrays([pa.array(m[key, 0]), pa.array(m[key, 1]), pa.ListArray.from_arrays(pa.array(np.append(key, len(m)).astype(np.int32)), runs)], ["doc_id", "content", "runs"])

    for batch in batches:
        m = np.concatenate((held, np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(6)], axis=1)))
        if not len(m):
            continue
        m = m[np.append(True, (m[1:, :3] != m[:-1, :3]).any(axis=1))]  # rows equal in id and text
        # a run goes on where both the document and its source do
        same = (m[1:, [0, 1, 4]] == m[:-1, [0, 1, 4]]).all(axis=1) & (m[1:, 2] == m[:-1, 2] + m[:-1, 3]) & (m[1:, 5] == m[:-1, 5] + m[:-1, 3])
        begin = np.flatnonzero(np.append(True, ~same))
        total = np.add.reduceat(m[:, 3], begin)
        m = m[begin]
        m[:, 3] = total
        open_ = int(np.flatnonzero((m[:, :2] == m[-1, :2]).all(axis=1))[0])  # the last document may go on in the next batch
        if open_:
            yield rows(m[:open_])
        held = m[open_:]
    if len(held):
        yield rows(held)


def parse(runs: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Greedy factors (start, length, source, source_start) of a document's runs in order, and the spans found at their boundaries."""
    factors: list[tuple[int, int, int, int]] = []
    edges: list[tuple[int, int]] = []
    position = covered = 0
    for start, windows, source, at in runs:
        stop = start + windows + WINDOW - 1
        begin = max(start, position)
        if stop - begin >= WINDOW:
            # the part of the run that an earlier factor covers is behind the parse
            factors.append((begin, stop - begin, source, at + begin - start))
            position = stop
        elif stop > covered:
            edges.append((start, stop))
        covered = max(covered, stop)
    return factors, edges


def _keep(batches):
    """What stays of each document, and its factors."""
    shape = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
    for batch in batches:
        total, gone, digest, kept, parsed = [], [], [], [], []
        for text, cut in zip(batch.column(1).to_pylist(), batch.column(2)):
            words = (text or "").encode().split()
            total.append(len(words))
            factors = []
            if cut.is_valid:
                factors, edges = parse(list(zip(*(cut.values.field(i).to_pylist() for i in range(4)))))
                depth = np.zeros(len(words) + 1, np.int64)
                for low, high in [*((f[0], f[0] + f[1]) for f in factors), *edges]:
                    depth[low] += 1
                    depth[high] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
            gone.append(total[-1] - len(words))
            rest = b" ".join(words)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode())
            parsed.append([dict(zip(("start", "length", "source", "source_start"), f)) for f in factors])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()), pa.array(parsed, shape)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"])


KEY = ["doc_id", "content"]
_FACTORS = "array<struct<start:int,length:int,source:long,source_start:int>>"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))


def matches(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document (doc_id and a hash of its text): the runs of its windows that the reference has, in order; only documents that have some."""
    prepare(spark)
    docs = _texts(docs).where("doc_id is not null")
    blocks = written(spark, docs.mapInArrow(_blocks, "anchor long, block long, doc_id long, content long, start int, windows int"), "blocks")
    # sides with one row per key are written, so that a join that reads them back can split a skewed key
    met = written(spark, blocks.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "met")
    shared = written(spark, blocks.join(met, "anchor"), "shared")
    first = F.min(F.struct(F.col("doc_id").alias("source"), F.col("start").alias("source_start")))
    home = written(spark, shared.groupBy("anchor", "block").agg(first.alias("h")).select("anchor", "block", "h.*"), "home")
    factors = shared.join(home, ["anchor", "block"])
    whole = factors.where("doc_id > source").select(*KEY, "start", "windows", "source", "source_start")

    several = written(spark, home.groupBy("anchor").agg(F.min("source").alias("low"), F.max("source").alias("high")).where("low < high").select("anchor"), "several")
    # every occurrence in the first document is opened; copies of a row under one doc_id are opened once
    own = factors.where("doc_id = source").select("anchor", *KEY, "start", "windows").distinct()
    opened = own.join(several, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    windows = written(spark, docs.join(opened, KEY).select("doc_id", "text", "content", "spans").mapInArrow(_windows, "w1 long, w2 long, doc_id long, content long, start int"), "windows")
    seen = windows.groupBy("w1", "w2").agg(first.alias("h"), F.max("doc_id").alias("high")).where("h.source < high")
    partial = windows.join(written(spark, seen.select("w1", "w2", "h.*"), "source"), ["w1", "w2"]).where("doc_id > source").select(*KEY, "start", F.lit(1).alias("windows"), "source", "source_start")
    found = whole.unionByName(partial)
    return found.repartition(*KEY).sortWithinPartitions(*KEY, "start").mapInArrow(_runs, "doc_id long, content long, runs array<struct<start:int,windows:int,source:long,source_start:int>>")


def remove_duplicate_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space) and factors."""
    runs = matches(spark, docs)
    return _texts(docs).join(runs, KEY, "left").select("doc_id", "text", "runs").mapInArrow(_keep, f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, factors {_FACTORS}")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicate_spans(spark, table(spark, sf_dir, "documents")).drop("kept", "factors")
