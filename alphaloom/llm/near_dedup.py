"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

``near_duplicates`` links two documents when the Jaccard similarity of their word shingles reaches a
threshold, and returns for each document the smallest id of its connected component.

Sketch. Round r throws each shingle into one of BINS bins by a hash; a bin keeps the smallest value
of the first round that reaches it. From round BINS on, round r throws every shingle into bin
r - BINS, so after 2 * BINS rounds no bin is empty. A long text needs one or two rounds in all,
where plain MinHash hashes each shingle once per bin.

Banding. ROWS bins make a band; texts that agree on a band are candidates. With the defaults a link
at exactly 0.75 has no common band with probability (1 - 0.75**5)**56 < 3e-7; this is the only way
to lose one.

Verification. Documents with equal sets are one class first, so copies cost nothing more; from then on classes, by
numbers of their own, are what is compared and connected, and rows that share a doc_id connect their classes. A bucket is
the classes that agree on one band. Each class is compared with its buckets' smallest class, the hub,
which is linear in the buckets: a hub's set is held while the others stream by, and a hub with many
others is dealt into parts of STAR_DOCS. What that links is contracted into components. Buckets that
now lie in one component are done, and so are those of two classes; what is left is each bucket's
classes outside its largest component, and those are compared with the whole bucket, in blocks of
bounded size and of like set sizes, where equal buckets are done once. Sets whose sizes alone rule a link out never meet,
neither at a hub nor in blocks. A task returns a spanning forest of the links that it
verified on full sets, so its output is linear in the documents that it saw. Only documents that share a band are ever compared:
chains of buckets between texts that are not alike bring nothing together.

Defined cases: a null or empty text, or one without words, has no shingles, links with nothing and
is kept; a text of fewer words than a shingle is one shingle; rows that share a doc_id are each in the
result and all in one component, with everything that any of their texts links to (rows without shingles aside); a null doc_id cannot be named in a
component: such a row is dropped, or with ``nameless`` returned with a null component and kept, and it is
no node of the graph; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import forget, prepare, table, text_bytes, written
from alphaloom.llm.components import components
from alphaloom.llm.words import U, mix, shingle_sets, split_words

BANDS, ROWS = 56, 5
BINS = BANDS * ROWS
SHINGLE, PERCENT = 5, 75
#: Documents and shingles of a bucket, or of a block of one, that a task takes at once, and documents that are compared with one copy of a hub.
BLOCK_DOCS, BLOCK_SHINGLES, STAR_DOCS = 512, 1_000_000, 4096
#: Step between levels of set sizes: a little more than 100 / PERCENT, so linked sets are on one level or on neighbouring ones, however logarithms are rounded.
LEVEL_STEP, LEVEL_BLOCKS = 1.005 * 100 / PERCENT, 1 << 24

_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_BOUNDS = np.arange(BINS, dtype=U) << U(54)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BINS values; two sets agree on one with a probability close to their Jaccard similarity."""
    out = np.zeros(BINS, U)
    empty = np.ones(BINS, bool)
    step = max(1, int(1.15 * BINS * np.log(BINS) / len(shingles)))
    start = 0
    while start < 2 * BINS and empty.any():
        rounds = np.arange(start, min(start + step, 2 * BINS))
        h = mix(shingles[None, :] ^ _SEEDS[rounds][:, None])
        where = ((h >> U(32)) * U(BINS)) >> U(32)
        late = rounds >= BINS
        if late.any():
            where[late] = (rounds[late] - BINS)[:, None].astype(U)
        # bin, then round, then value: the first entry of each bin in sorted order is the bin's
        key = np.sort(((where << U(54)) | (rounds.astype(U)[:, None] << U(44)) | (mix(h) >> U(20))).ravel())
        at = np.searchsorted(key, _BOUNDS)
        key = np.append(key, ~U(0))
        won = empty & (key[at] >> U(54) == np.arange(BINS, dtype=U))
        out[won] = key[at[won]]
        empty &= ~won
        start = int(rounds[-1]) + 1
    return out


def band_keys(sketched: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    key = np.arange(1, BANDS + 1, dtype=U)
    for column in sketched.reshape(BANDS, ROWS).T:
        key = mix(key * U(0x9E3779B97F4A7C15) ^ column)
    return key


def _summaries(batches):
    """doc_id, number of shingles, two fingerprints of the set and its band keys."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        sets = shingle_sets(split_words(data, offsets, lower=True), SHINGLE)
        marks = _marks(sets)
        keys = [band_keys(sketch(s)) if len(s) else s for s in sets]
        sizes = np.array([len(k) for k in keys], np.int32)
        values = np.concatenate(keys).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))],
            ["doc_id", "n_shingles", "mark1", "mark2", "bands"],
        )


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """Two fingerprints of each set."""
    return np.array([[np.add.reduce(s), np.add.reduce(mix(s ^ U(77)))] if len(s) else (0, 0) for s in sets], U).reshape(-1, 2).astype(np.int64)


def _sets(batches):
    """Rows (class, mark1, mark2, routes, text) to the routes of each class, with its set as bytes; a text of another class that shares the doc_id is passed by."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(4))
        sets = shingle_sets(split_words(data, offsets, lower=True), SHINGLE)
        own = pa.array((_marks(sets) == np.column_stack((np.asarray(batch.column(1)), np.asarray(batch.column(2))))).all(axis=1))
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "routes", "shingles"])
        yield out.filter(own)


def _forest(ids: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links between ``left`` and ``right`` (flags) connect, each verified on full sets."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []

    def link(i: int, j: int) -> None:
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((ids[i], ids[j]))

    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) <= 12:
        for i in range(len(ids)):
            for j in range(i):
                if (left[i] and right[j]) or (left[j] and right[i]):
                    a, b = int(sizes[i]), int(sizes[j])
                    if PERCENT * max(a, b) <= 100 * min(a, b) and root(i) != root(j):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= PERCENT * (a + b - both):
                            link(i, j)
        return edges
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    shared, code = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(code, minlength=len(shared))
    dense = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    use = counts[code] > 1
    owner, code = owner[use], dense[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(rows), len(columns)), np.float32)
    width = 2048
    for at in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        a, b = np.searchsorted(code, (at, at + width))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], code[a:b] - at] = 1
        both += held[rows] @ held[columns].T
    total = sizes[rows][:, None] + sizes[columns][None, :]
    for i, j in np.argwhere(100 * both >= PERCENT * (total - both)).tolist():
        if rows[i] != columns[j]:
            link(int(rows[i]), int(columns[j]))
    return edges


def _links(batches):
    """Sorted rows (key, x, y, side, class, shingles) to edges, one group in memory at a time; side 0: left, 1: right, 2: both."""
    held: tuple | None = None
    ids: list[int] = []
    sides: list[int] = []
    sets: list[np.ndarray] = []

    def flush():
        if len(ids) > 1:
            side = np.array(sides)
            edges = _forest(ids, sets, side != 1, side != 0)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])
        ids.clear(), sides.clear(), sets.clear()

    for batch in batches:
        for key, side, doc, raw in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
            if key != held:
                yield from flush()
                held = key
            ids.append(doc), sides.append(side), sets.append(np.frombuffer(raw.as_py(), U))
    yield from flush()


def _star_links(batches):
    """Sorted rows (hub, part, y, side, class, shingles), the hub itself first in each part: its verified edges."""
    held, hub = None, np.zeros(0, U)
    for batch in batches:
        keys, parts, sides = (np.asarray(batch.column(i)) for i in (0, 1, 3))
        ids = np.asarray(batch.column(4))
        raw, offsets = text_bytes(batch.column(5))
        offsets = offsets // 8
        values = np.frombuffer(np.ascontiguousarray(raw), U)
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])))
        left, right = [], []
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
            if (keys[low], parts[low]) != held:
                held, hub = (keys[low], parts[low]), np.zeros(0, U)
            if sides[low] == 0:
                hub = values[offsets[low] : offsets[low + 1]].copy()
                low += 1
            if low == high or not len(hub):
                continue
            some = values[offsets[low] : offsets[high]]
            at = np.minimum(np.searchsorted(hub, some), len(hub) - 1)
            both = np.add.reduceat(hub[at] == some, offsets[low:high] - offsets[low], dtype=np.int64)
            union = np.diff(offsets[low : high + 1]) + len(hub) - both
            linked = ids[low:high][100 * both >= PERCENT * union]
            left.append(linked)
            right.append(np.full(len(linked), held[0], np.int64))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


_ROUTES = "cls long, routes array<struct<key:long,x:int,y:int,side:int>>, shingles binary"


def _verified(texts: DataFrame, routes: DataFrame, compare) -> DataFrame:
    """Edges among classes, of which ``texts`` has texts, that ``routes`` (cls, routes: array of (key, x, y, side)) brings together in tasks."""
    sets = texts.join(routes, "cls").select("cls", "mark1", "mark2", "routes", "text").mapInArrow(_sets, _ROUTES)
    # rows of one id and one text are one class once
    dealt = sets.select("cls", "shingles", F.explode("routes").alias("r")).select("r.key", "r.x", "r.y", "r.side", "cls", "shingles")
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side").mapInArrow(compare, "a long, b long")


def _route(key: str, x: Column, y: Column, side: Column) -> Column:
    return F.struct(F.col(key).alias("key"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))


def _stars(shared: DataFrame) -> DataFrame:
    """Routes that bring each class to its buckets' hubs."""
    zero = F.lit(0)
    sizes = (F.col("n_shingles"), F.col("hub_shingles"))
    near = shared.where("cls <> hub").where(PERCENT * F.greatest(*sizes) <= 100 * F.least(*sizes)).select("cls", "hub").distinct()
    parts = near.groupBy("hub").agg(F.ceil(F.count("*") / STAR_DOCS).cast("int").alias("parts"))
    spokes = near.join(parts, "hub").select("cls", _route("hub", F.expr("pmod(xxhash64(cls), parts)"), zero, F.lit(1)).alias("r"))
    spokes = spokes.groupBy("cls").agg(F.collect_list("r").alias("routes"))
    hubs = parts.select(F.col("hub").alias("cls"), F.transform(F.sequence(zero, F.col("parts") - 1), lambda x: _route("hub", x, zero, zero)).alias("routes"))
    return spokes.unionByName(hubs)


def _open_buckets(spark: SparkSession, shared: DataFrame, found: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Routes (if any bucket is open) that compare, in each bucket of several components, the classes outside the largest one with all others, and the tables that they read."""
    mark = [F.xxhash64("cls", F.lit(k)) for k in (1, 2)]
    parts = shared.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    parts = written(spark, parts.select("band", "cls", "n_shingles", "component"), "parts")
    buckets = parts.groupBy("band").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("load"), F.min("component").alias("low"), F.max("component").alias("high"), *(F.bit_xor(m).alias(f"m{k}") for k, m in enumerate(mark)))
    once = buckets.where("docs > 2 and low < high").groupBy("m0", "m1", "docs", "load").agg(F.min("band").alias("band")).select("band", "docs", "load")
    once = written(spark, once, "open")
    if once.isEmpty():
        return None, [parts, once]
    # a bucket that is one block is one level
    large = (F.col("docs") > BLOCK_DOCS) | (F.col("load") > BLOCK_SHINGLES)
    level = F.when(large, F.floor(F.log("n_shingles") / math.log(LEVEL_STEP)).cast("int")).otherwise(0)
    rows = written(spark, parts.join(once, "band").withColumn("level", level), "outside")
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    joined = rows.join(main, "band").withColumn("outside", F.col("component") != F.col("main"))
    # per level of a bucket: blocks of all its classes, and of those outside
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    levels = joined.groupBy("band", "level").agg(blocks.alias("blocks"), F.ceil(F.count_if("outside") * blocks / F.count("*")).cast("int").alias("minors"))
    shape = levels.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("blocks", "minors")))).alias("shape"))
    shape = written(spark, shape, "shape")
    joined = joined.join(shape, "band")

    def numbers(step: int, kind: str) -> Column:
        """Numbers of the blocks (or minors) of the level ``step`` away, none if it has none."""
        there = F.col("level") + step
        count = F.coalesce(F.try_element_at("shape", there)[kind], F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0), count), lambda k: k < count), lambda k: there * LEVEL_BLOCKS + k)

    own = F.try_element_at("shape", F.col("level"))
    number = F.col("level") * LEVEL_BLOCKS
    joined = joined.withColumn("block", number + F.pmod(F.xxhash64("cls"), own["blocks"]).cast("int"))
    joined = joined.withColumn("mine", F.when(F.col("outside"), number + F.pmod(F.xxhash64("cls", F.lit(1)), own["minors"]).cast("int")))
    # task (x, y): the classes of outside block x against block y of the bucket, of the same level or a neighbouring one
    minors, others = (F.concat(*(numbers(step, kind) for step in (-1, 0, 1))) for kind in ("minors", "blocks"))
    right = F.transform(minors, lambda x: _route("band", x, F.col("block"), F.when(x.eqNullSafe(F.col("mine")), 2).otherwise(1)))
    left = F.transform(F.filter(others, lambda y: y != F.col("block")), lambda y: _route("band", F.col("mine"), y, F.lit(0)))
    routes = joined.select("cls", F.when(F.col("outside"), F.concat(right, left)).otherwise(right).alias("routes"))
    return routes.groupBy("cls").agg(F.flatten(F.collect_list("routes")).alias("routes")), [parts, once, rows, shape]


def near_duplicates(spark: SparkSession, docs: DataFrame, nameless: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (see the module's docstring)."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not nameless:
        docs = docs.where("doc_id is not null")
    seen = written(spark, docs.mapInArrow(_summaries, "doc_id long, n_shingles long, mark1 long, mark2 long, bands array<long>"), "sketches")
    key = ["mark1", "mark2", "n_shingles"]
    filled = seen.where("n_shingles > 0 and doc_id is not null")
    classes = written(spark, filled.groupBy(key).agg(F.min("doc_id").alias("rep")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    member = written(spark, filled.select("doc_id", *key).join(classes.select(*key, "cls"), key).select("doc_id", "n_shingles", "cls"), "members")

    # one row of each class carries the bands
    heads = classes.select(*key, "cls", F.col("rep").alias("doc_id"))
    bands = filled.join(heads, ["doc_id", *key]).select("cls", "n_shingles", F.explode("bands").alias("band"))
    lowest = bands.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("top"), F.min_by("n_shingles", "cls").alias("hub_shingles"))
    hubs = written(spark, lowest.where("hub < top").select("band", "hub", "hub_shingles"), "hubs")
    shared = written(spark, bands.join(hubs.hint("merge"), "band").dropDuplicates(["band", "cls"]), "shared")
    forget(spark, hubs)
    # texts of classes that share a bucket with others: all texts are shuffled once, for these
    near = shared.select("cls").distinct().join(classes.select("cls", F.col("rep").alias("doc_id"), "mark1", "mark2"), "cls")
    texts = written(spark, docs.join(near, "doc_id").select("cls", "mark1", "mark2", "text"), "texts")

    # rows of one id connect their classes
    several = member.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("doc_id", "low")
    same_id = member.join(several, "doc_id").select(F.col("cls").alias("a"), F.col("low").alias("b"))
    found = written(spark, components(spark, _verified(texts, _stars(shared), _star_links).unionByName(same_id), "a", "b"), "components")
    rest, steps = _open_buckets(spark, shared, found)
    if rest is not None:
        # the components found so far are edges, too
        both = _verified(texts, rest, _links).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = written(spark, components(spark, both, "a", "b"), "components")
    forget(spark, shared, texts, *steps)
    own = found.withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls")
    names = own.groupBy("component").agg(F.min("rep").alias("name"))
    named = classes.join(own.join(names, "component").select("cls", "name"), "cls", "left").select("cls", F.coalesce("name", "rep").alias("component_id"))
    labelled = member.join(named, "cls").select("doc_id", "n_shingles", "component_id")
    alone = seen.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), nameless=True)
