"""Whitening, periodic runs and line dedup, against brute force on small and awkward tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SHAPE, by_id, docs, odd_tables, texts  # noqa: F401

from alphaloom.llm import line_dedup, runs, whitening

# --- 11

VECTORS = "vec_id long, embedding array<float>, label int, n long"


def _vectors(count, dim, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dim)) @ rng.normal(size=(dim, dim)) + rng.normal(size=dim)
    return [(i, [float(np.float32(v)) for v in row], i % 3, 7) for i, row in enumerate(x)]


def _whitened(rows):
    """Rows of brute force: vec_id, n, deviation, and eigenvalues and trace."""
    sound = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    own = sorted({tuple(x) for _, x in sound})
    n, dim = len(own), len(own[0])
    sums = [sum(x[k] for x in own) for k in range(dim)]
    y = np.array([[(n * x[k] - sums[k]) / n for k in range(dim)] for x in own])
    v = y.T @ y / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    out = {}
    for i, x in sound:
        d = [n * x[k] - sums[k] for k in range(dim)]
        out.setdefault(i, []).append((n, sum(t * t for t in d), np.array(d) / n @ c[:, :16] / np.sqrt(e[:16])))
    return out, e, np.trace(v)


def test_whitening(spark):
    rows = _vectors(300, 20)
    rows += [(1000 + i, rows[0][1], 0, 7) for i in range(200)]  # copies of one vector
    rows += [(2000, None, 0, 7), (2001, [], 0, 7), (2002, [None] + [1.0] * 19, 0, 7), (2003, [float("nan")] * 20, 0, 7), (2004, [float("inf")] * 20, 0, 7), (2005, [1.0, 2.0], 0, 7), (5, rows[5][1], 0, 7)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.fit(spark, df).apply(df).collect()
    want, e, trace = _whitened([r for r in rows if r[0] != 2005])
    assert len(got) == 16 * (300 + 200 + 1) and {r["vec_id"] for r in got} == set(want)
    turn = {}
    for r in got:
        n, deviation, w = want[r["vec_id"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        k = r["component"] - 1
        turn.setdefault(k, np.sign(r["whitened"] * w[k]))
        assert abs(r["whitened"] - turn[k] * w[k]) < 1e-8
        assert abs(r["explained"] - e[k] / trace) < 1e-10 and 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_whitening_of_odd_tables(spark):
    def run(rows):
        df = spark.createDataFrame(rows, VECTORS)
        return whitening.fit(spark, df).apply(df).collect()

    assert run([]) == [] and run([(1, None, 0, 7)]) == []
    assert run([(1, [1.0, 2.0], 0, 7)] * 3) == []  # no variance
    # a column that repeats another has no component of its own; a null id is kept
    got = run([(None, [float(i), 2.0 * i, 1.0], 0, 7) for i in range(5)])
    assert len(got) == 5 and {(r["vec_id"], r["component"]) for r in got} == {(None, 1)} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    # beyond 64 bits: clipped, exact sums, no deviation
    got = run([(1, [3e38, 0.0], 0, 7), (2, [-3e38, 1.0], 0, 7), (3, [0.0, 5.0], 0, 7)])
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["deviation"] is None for r in got if r["vec_id"] < 3)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        b = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-4, 4, rank)
        a = b @ b.T
        f, order = whitening.pivoted_cholesky(a)
        assert f.shape[1] <= size and np.allclose(f @ f.T, a[np.ix_(order, order)], rtol=0, atol=1e-10 * a.max())
        assert np.allclose(f, np.tril(f))
        turned = whitening.jacobi(f)
        norms = np.sort((turned**2).sum(0))[::-1]
        assert np.allclose(norms, np.linalg.eigvalsh(a)[::-1][: len(norms)], rtol=1e-9, atol=1e-12 * a.max())
        unit = turned / np.sqrt((turned**2).sum(0))
        assert np.abs(unit.T @ unit - np.eye(unit.shape[1])).max() < 1e-10


# --- 12


def _lyndon(t, i):
    """The longest Lyndon word at i, as the way to the next smaller suffix."""
    j = i + 1
    while j < len(t) and t[j] and t[j:] > t[i:]:
        j += 1
    return tuple(t[i:j])


def _all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rng):
    k, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(1, 40)
    w = [rng.randint(1, k) for _ in range(n)]
    if rng.random() < 0.5:
        block = [rng.randint(1, k) for _ in range(rng.randint(1, 5))]
        w[rng.randint(0, n) :] = (block * 10)[: rng.randint(4, 40)]
    return w


def test_lyndon_groups():
    rng = random.Random(2)
    for _ in range(1500):
        w = _words(rng)
        if rng.random() < 0.4:
            w = [*w, 0, *_words(rng), 0]
        groups, sizes = runs.lyndon_groups(w)
        words = {}
        for i in range(len(w)):
            if w[i]:
                assert sizes[i] == len(_lyndon(w, i)), (w, i)
                words.setdefault(int(groups[i]), set()).add(_lyndon(w, i))
        assert all(len(v) == 1 for v in words.values()) and len(set().union(*words.values())) == len(words)


def test_find_runs():
    rng = random.Random(4)
    for _ in range(2500):
        w = _words(rng)
        assert [tuple(r) for r in runs.find_runs(np.array(w)).tolist()] == _all_runs(w), w
    morse = [1 + bin(i).count("1") % 2 for i in range(3000)]  # no overlaps at all
    assert len(runs.find_runs(np.array(morse))) == 0
    assert runs.find_runs(np.array([1] * 200_000)).tolist() == [[0, 200_000, 1]]


def _op12(doc, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    n = len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _all_runs(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("at_once", [4 << 20, 300])
def test_periodic_runs(spark, docs, tmp_path, at_once, monkeypatch):  # noqa: F811
    monkeypatch.setattr(runs, "AT_ONCE", at_once)
    monkeypatch.setattr(runs, "JOINED", 100)
    rng = random.Random(9)
    more = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["x y\x0b x y\n" * 30 + "é"]
    rows = docs.drop("row").unionByName(spark.createDataFrame([(500 + i, t, "en", "s", 1) for i, t in enumerate(more)], SHAPE).withColumn("words", F.lit("clash")))
    for name, odd in {"all": rows, **odd_tables(spark, rows)}.items():
        odd.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted((tuple(r) for r in runs.op12(spark, f"{tmp_path}/{name}").collect()), key=str)
        assert got == sorted(((r["doc_id"], *_op12(r["doc_id"], r["text"])) for r in odd.collect()), key=str), name


# --- 13


def _op13(rows):
    blank = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    keys = lambda t: [x.strip(blank).translate(lower) for x in (t or "").split("\n")]
    place = lambda i: math.inf if i is None else i
    holders = {}
    for i, t in rows:
        for k in keys(t):
            holders.setdefault(k, set()).add(place(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _lined(seed=6):
    rng = random.Random(seed)
    stock = [f"line number {k} of them" for k in range(40)] + ["short", "ééééééééé", "éééééééééé", "tenletters", "  Mixed CASE line \t", "mixed case LINE", "", " ", "\x0bodd\x1cbytes here\r", "null \0 byte line"]
    out = ["\n".join(rng.choice(stock) if rng.random() < 0.5 else f"own {rng.random()} words" for _ in range(rng.randint(1, 12))) for _ in range(150)]
    return out + [None, "", "\n", "\n\n", "the hot line of all\n" * 3] + [f"the hot line of all\nown {k} and more" for k in range(60)]


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, tmp_path, small, monkeypatch):
    if small:  # the way beyond a broadcast, with several segments and several copies of each
        for name, value in (("BROADCAST_BYTES", 0), ("SEGMENT_KEYS", 100), ("SEGMENT_BITS", 1 << 12), ("PART_ROWS", 20), ("_HELD", 50)):
            monkeypatch.setattr(line_dedup, name, value)
    rows = [(i * 3 % 401, t, "en", "s", 1) for i, t in enumerate(_lined())]
    docs = spark.createDataFrame(rows, SHAPE).withColumns({"n_lines": F.lit("clash"), "key": F.lit(1), "a.b": F.lit(2)}).repartition(6)
    for name, odd in {"all": docs, **odd_tables(spark, docs), "shared id": docs.withColumn("doc_id", F.col("doc_id") % 7)}.items():
        odd.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted((tuple(r) for r in line_dedup.op13(spark, f"{tmp_path}/{name}").collect()), key=str)
        assert got == _op13([(r["doc_id"], r["text"]) for r in odd.collect()]), name
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert {r["text"] for r in out.where("doc_id is null or text is null").collect()} == {None}


def test_second_filter_holds_every_repeat():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    once, twice = np.zeros(line_dedup.SEGMENT_BITS, bool), np.zeros(line_dedup.SEGMENT_BITS, bool)
    for part in (hashes[:3000], hashes[2000:]):
        bits = line_dedup._bits(part)
        twice[bits[once[bits].all(axis=1)]] = True
        once[bits] = True
    met = line_dedup._met(np.packbits(twice), line_dedup._bits(hashes))
    assert met[2000:3000].all() and met.sum() < 1010
