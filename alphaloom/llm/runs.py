"""Periodic runs of words, from Lyndon arrays that come out of grouping, the first phase of suffix sorting.

A run is a stretch of consecutive words with smallest period q, of LEAST_WORDS words and LEAST_PERIODS periods at least, that
neither neighbour extends. ``periodic_runs`` finds all runs of each text and drops what repeats within
them.

Grouping. Suffixes begin in one group per word. Groups are taken from the greatest down; each member's
nearest position to the left in a smaller group has its own group's prefix grow by the taken group's, once
per member that names it, so that it moves into a new group right above its own. A list of the positions that are
left, from which members are unlinked from left to right, gives those positions without a search. In the
end a group is all suffixes with the same longest Lyndon prefix: the Lyndon array is the groups' lengths. This is
done under the order of words and under its reverse.

Runs. Each run's Lyndon roots are the longest Lyndon words at their positions under one of the two
orders, so of a run with LEAST_PERIODS periods three neighbouring roots are of one group. The first root of each such
chain is extended to both sides by longest common extensions, compared in blocks; both orders' runs are put together.

Before that, words that can't be part of a run are left out, exactly: each three words in a row within a run occur three
times or more in it, and so does each neighbour's triple, so only stretches of such triples are grouped. What is left is
grouped by the words' bytes, never by hashes. A text is one row of one task, in time that is linear in its words but for sorting.

Defined cases: a null or empty text, or one without words, has no runs and an empty result; repeated rows are
treated alike; a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import by_bytes, prepare, table, text_bytes
from alphaloom.llm.words import U, mix, run_hashes, split_words

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are taken at once, and words of a text that are joined at once.
AT_ONCE, JOINED = 4 << 20, 50_000
_RUN = "array<struct<start:long,length:long,period:long>>"


def lyndon_groups(text: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each position its group, and the length of the longest Lyndon word there; equal groups mean equal words. Numbers from 1; 0 ends a text and is in no word."""
    count = len(text)
    symbols = sorted(set(text))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(symbols)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    left, right = list(range(-1, count - 1)), list(range(1, count + 1))
    g, last = len(symbols) - 1, 0 if symbols and symbols[0] == 0 else -1
    while g > last:
        moved: dict[tuple[int, int], list[int]] = {}
        named, times = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            before, after = left[i], right[i]
            if after < count:
                left[after] = before
            if before >= 0:
                right[before] = after
            if before == named:
                times += 1
                continue
            if named >= 0:
                moved.setdefault((times, group[named]), []).append(named)
            named, times = before, 1
        if named >= 0:
            moved.setdefault((times, group[named]), []).append(named)
        # more repetitions are greater: they are put right above their group first, fewer ones then go in between
        for times, own in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            if own <= last:
                continue
            new, top = len(size), above[own]
            positions = moved[times, own]
            members.append(positions)
            size.append(size[own] + times * size[g])
            below.append(own)
            above.append(top)
            above[own] = new
            if top >= 0:
                below[top] = new
            for j in positions:
                group[j] = new
        g = below[g]
    groups = np.array(group, np.int64)
    return groups, np.array(size, np.int64)[groups] if count else groups


def _extension(x: np.ndarray, a: int, b: int, step: int) -> int:
    """Positions from a and b (b beyond a), in direction ``step``, that agree: a longest common extension, in blocks of growing size."""
    done, block = 0, 64
    while True:
        room = len(x) - b - done if step > 0 else a + 1 - done
        block = min(block, room)
        if block <= 0:
            return done
        if step > 0:
            differ = x[a + done : a + done + block] != x[b + done : b + done + block]
        else:
            differ = x[a - done - block + 1 : a - done + 1][::-1] != x[b - done - block + 1 : b - done + 1][::-1]
        if differ.any():
            return done + int(np.argmax(differ))
        done, block = done + block, block * 4


def find_runs(text: np.ndarray) -> np.ndarray:
    """All runs (start, length, period) of numbers from 1; 0 ends a text and is in no run."""
    found = set()
    ends = text == 0
    x = np.where(ends, -np.arange(len(text)) - 1, text)  # ends differ from each other
    for order in (text, np.where(ends, 0, text.max(initial=0) + 1 - text)):
        groups, sizes = lyndon_groups(order.tolist())
        at = np.flatnonzero(~ends & (np.arange(len(text)) + 2 * sizes < len(text)))
        p = sizes[at]
        chain = (groups[at + p] == groups[at]) & (groups[at + 2 * p] == groups[at]) & ((at < p) | (groups[np.maximum(at - p, 0)] != groups[at]))
        for i, q in zip(at[chain].tolist(), p[chain].tolist()):
            back = _extension(x, i - 1, i + q - 1, -1)
            length = back + q + _extension(x, i, i + q, 1)
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.add((i - back, q, length))
    return np.array([(s, n, q) for s, q, n in sorted(found)], np.int64).reshape(-1, 3)


def _stretches(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last word of the stretches that may hold runs: all triples in them occur three times in their text, then in their stretch."""
    triples = run_hashes(hashes, 3)
    if not len(triples):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    own = owner[at].astype(U)
    while True:
        _, code, count = np.unique(mix(triples[at] ^ mix(own + U(1))), return_inverse=True, return_counts=True)
        kept = count[code] > 2
        at, own = at[kept], own[kept]
        # neighbours of one text are one stretch; those of fewer than LEAST_WORDS words are none
        first = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(own, prepend=own[:1]) != 0)) if len(at) else at
        sizes = np.diff(np.append(first, len(at)))
        long = sizes >= LEAST_WORDS - 2
        if kept.all() and long.all():
            return at[first], at[first] + sizes + 2
        at = at[np.repeat(long, sizes)]
        own = np.repeat(np.arange(int(long.sum()), dtype=U), sizes[long])


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(b" ".join([raw[s:e] for s, e in zip(starts[k : k + JOINED].tolist(), ends[k : k + JOINED].tolist())]) for k in range(0, len(starts), JOINED))


def _collapsed(tail: Callable[[int | None, int], tuple[int, int] | None]):
    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, 1, AT_ONCE):
                yield one(batch)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        words = split_words(data, offsets)
        first, sizes = words.first, np.diff(words.first)
        order = np.arange(len(words.starts))
        changed = np.zeros(len(sizes), bool)
        for d, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist())):
            turn = tail(doc, n) if n else None
            if turn is not None:
                a, p = turn
                order[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
                changed[d] = True
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin, stop = _stretches(words.hashes[order], owner)
        # the stretches one behind the other, an end behind each, words as numbers
        lengths = stop - begin
        places = np.cumsum(lengths + 1) - lengths - 1
        where = np.repeat(begin - places, lengths + 1) + np.arange(int((lengths + 1).sum()))
        picked = order[np.minimum(where, max(0, len(order) - 1))]
        number: dict[bytes, int] = {}
        text = np.array([number.setdefault(raw[s:e], len(number) + 1) for s, e in zip(words.starts[picked].tolist(), words.ends[picked].tolist())], np.int64)
        text[places + lengths] = 0
        found = find_runs(text)
        home = np.searchsorted(places, found[:, 0], "right") - 1
        start = found[:, 0] - places[home] + begin[home] if len(found) else found[:, 0]
        docs = owner[start]
        sort = np.lexsort((found[:, 2], start))
        start, docs, length, period = start[sort], docs[sort], found[sort, 1], found[sort, 2]
        fall = np.zeros(len(order) + 1, np.int64)
        np.add.at(fall, start + period, 1)
        np.add.at(fall, start + length, -1)
        keep = np.cumsum(fall[:-1]) == 0
        hurt = changed.copy()
        hurt[docs] = True
        texts = []
        for d in range(len(sizes)):
            a, b = int(first[d]), int(first[d + 1])
            if hurt[d] or offsets[d + 1] - offsets[d] > AT_ONCE:
                mine = order[a:b][keep[a:b]]
                texts.append(_kept(raw, words.starts[mine], words.ends[mine]))
            else:
                texts.append(b" ".join(raw[offsets[d] : offsets[d + 1]].split()))
        runs = pa.StructArray.from_arrays([pa.array(start - first[docs]), pa.array(length), pa.array(period)], ["start", "length", "period"])
        cuts = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=len(sizes))))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), runs), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return run


def periodic_runs(spark: SparkSession, docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] = lambda doc_id, n: None) -> DataFrame:
    """Per text: doc_id, n_words, runs (start, length, period; by start, then period), and the text without words that a run holds after its first period.

    ``tail`` may give, for a doc_id and a number of words, a position a and a number p: the words from a on are then those p words again and again, before anything is looked for.
    """
    prepare(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_collapsed(tail), f"doc_id long, n_words long, runs {_RUN}, text string")


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """op12's rule: a tenth of the documents, told by the checksum of their ids, ends in copies of a few of its words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _most_periodic(runs: Column) -> Column:
    """The run of greatest length over period, compared in whole numbers; the first of several."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark, table(spark, sf_dir, "documents"), planted_tail).withColumn("best", _most_periodic(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
