"""Operators on texts, against brute force on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alphaloom.llm import bpe, chat, decontaminate, html_text, near_dedup, pii, quality_rules, substring_dedup, token_files, url_filters
from alphaloom.llm.components import components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = r"[^\x20\x09-\x0D]+"


def texts():
    """Plain, copied, near-copied, shared-passage, empty, null, long, repetitive and odd texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120).split(" ")
    passage = text(70)
    out = [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(8):
        near = list(base)
        for _ in range(k + 1):
            near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    out += [f"{text(30)}\n{passage} {text(20)}" for _ in range(6)]
    out += ["", None, " \n\t", "one", "one", "two words", "a b c d e", "a b c d e f " * 40, "x\x0by\x1cz\x85w　v", "😀 é " * 12, "\0 nul \0", "w" * 3000, text(6000)]
    out += ["\n".join(["the same line here", text(15), "the same line here"]) for _ in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", None, "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SHAPE).withColumn("row", F.lit(0)).withColumn("words", F.lit("clash")).persist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def odd_tables(spark, docs):
    """Empty; repeated rows; null ids; nothing but nulls."""
    twice = docs.where("doc_id in (0, 3, 12)").unionByName(docs.where("doc_id in (0, 3, 12)"))
    return {"empty": docs.limit(0), "twice": twice, "null id": docs.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long")), "null text": docs.where("doc_id < 3").withColumn("text", F.lit(None).cast("string"))}


# --- 1


def _contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = cut(t)
        m = min(13, len(w))
        for j in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[j : j + m]), set()).add(i)
    out = {}
    for i, t in docs:
        w = cut(t)
        hit, found = [False] * len(w), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if (k := tuple(w[j : j + m])) in windows:
                    found |= windows[k]
                    hit[j : j + m] = [True] * m
        n = sum(hit)
        out[i] = (len(w), n, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    plain = texts()
    items = [(1, " ".join(plain[0].split()[10:40])), (2, "one"), (3, "two-words"), (4, ""), (5, None), (20, " ".join(plain[0].split()[12:30])), (7, "C D E a"), (8, plain[13][:150])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(spark, docs, table).collect()}
    assert got == _contamination(enumerate(plain), items)
    assert decontaminate.contamination(spark, docs, table.limit(0)).where("n_hit > 0").count() == 0
    for name, odd in odd_tables(spark, docs).items():
        assert decontaminate.contamination(spark, odd, table).count() == odd.count(), name


def test_many_windows_take_two_scans(spark, docs, monkeypatch, tmp_path):
    """Beyond what is broadcast, texts are read twice, however many windows there are."""
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    plain = texts()
    items = [(k, t) for k, t in enumerate(plain) if t]
    table = spark.createDataFrame(items, "item_id long, text string")
    some = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    for block in (1_000, 10):  # some 8000 windows: 8 and 800 blocks
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        scans.value = 0
        got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(spark, some, table).collect()}
        assert got == _contamination(enumerate(plain), items)
        assert scans.value <= 2 * len(plain)


def test_a_window_that_all_items_share(spark, monkeypatch):
    """One passage in every item and in most documents: all items are named, in each block size."""
    passage, other = " ".join(f"p{i}" for i in range(13)), " ".join(f"q{i}" for i in range(13))
    items = [(i, f"{passage} own{i}" if i % 2 else passage) for i in range(300)] + [(999, other)]
    plain = [f"{passage} and more" for _ in range(20)] + [f"{other} {passage}", "clean words only", None, f"x {other}"]
    docs = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string").repartition(3)
    for block in (100_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        got = decontaminate.contamination(spark, docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r["doc_id"]: tuple(r)[1:6] for r in got} == _contamination(enumerate(plain), items)
        assert {r["doc_id"]: len(r["items"]) for r in got if r["doc_id"] in (0, 20, 21)} == {0: 300, 20: 301, 21: 0}


# --- 2


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum((v := int(c) * (i % 2 + 1)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark):
    rng = random.Random(9)
    alphabet = ["a", "b.c", "@", "@x.y", ".", "..", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (375) 555-4393", "+", " ", " ", "255.1.2.3", "256.1.1.1", "é", "😀", "-", "_", "%", "\n", "1.2.3.4.5"]
    plain = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    plain += [None, "", "9" * 20_000 + " " + "a.b" * 8_000 + "@", "x@" + "a." * 9_000, "7 " * 9_000]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    for r in pii.find(spark, df).collect():
        t = plain[r["doc_id"]] or ""
        want = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if _valid(k, m[0])] for k, p in PII.items()}
        joined = ",".join(s for k in PII for s in want[k])
        assert [r[f"n_{k}"] for k in PII] == [len(want[k]) for k in PII]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_pii_more_and_redaction(spark, docs):
    rng = random.Random(2)
    rows = [f"word {k} call +1 (375) 555-{k:04d} or mail u{k}@x.org from 10.0.0.{k % 250} about 12{k} or 300.1.1.{k}" for k in range(300)]
    rows += ["please mail jo.doe (at) host (dot) org or call (555) 123-4567 now", "nothing to see at the shop"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = by_id(pii.find(spark, df))
    extra = [s for s in found[300]["spans"].split(",") if s]
    assert any(s.startswith("email:12:") for s in extra) and found[301]["spans"] == ""
    clean = by_id(pii.redact(spark, df))
    assert clean[5]["text"] == "word 5 call [PHONE] or mail [EMAIL] from [IP] about 125 or 300.1.1.5"
    assert clean[301]["text"] == rows[301]
    for name, odd in odd_tables(spark, docs).items():
        assert pii.find(spark, odd).count() == odd.count(), name
    assert pii.redact(spark, docs).columns == docs.columns


def test_pii_model_on_held_out_contexts(spark):
    """Per kind: precision and recall on contexts that neither the trees have seen, and a token that only its context gives away."""
    model = pii.fit(spark)
    rows = [r for r in pii.described_examples(spark).collect() if r["held"]]
    for kind, trees in model.items():
        mine = [(r["label"], trees.value(tuple(r[f] for f in pii.FEATURES)) >= trees.threshold) for r in rows if r["kind"] == kind]
        chosen = [y for y, yes in mine if yes]
        assert sum(chosen) >= 0.98 * len(chosen) and sum(chosen) >= 0.85 * sum(y for y, _ in mine) > 5, kind
    assert set(model) == {k for k, _, _ in pii.MORE}
    key = "51c2" * 10
    df = spark.createDataFrame([(1, f'so token = "{key}" there'), (2, f"so commit {key} there"), (3, "pay 12 4111 1111 1111 1111 by card")], "doc_id long, text string")
    found = by_id(pii.find(spark, df))
    assert found[1]["spans"] == "secret:12:52" and found[2]["spans"] == "" and found[3]["spans"].startswith("card:7:26")
    assert by_id(pii.redact(spark, df))[1]["text"] == 'so token = "[SECRET]" there'


def test_pii_of_values_never_seen(spark):
    """Values of another seed, in speaking and in misleading sentences that no example has."""
    from alphaloom.llm import pii_examples as E

    speaking = {"email": "please mail {v} today", "phone": "you can call {v} today", "card": "charge my card {v} please", "ip": "the server {v} is down", "id": "my ssn {v} is here", "iban": "pay to iban {v} please", "secret": 'the token = "{v}" is here'}
    seen = {v for own in E.generated().values() for v, _ in own}
    rows = [(kind, telling, speaking[kind].replace("{v}", v), speaking[kind].index("{v}"), len(v)) for kind, own in E.generated(77).items() for v, telling in own if v not in seen]
    assert len(rows) > 400
    df = spark.createDataFrame([(k, r[2]) for k, r in enumerate(rows)], "doc_id long, text string")
    found = by_id(pii.find(spark, df))
    hits = {}
    for k, (kind, telling, _, at, n) in enumerate(rows):
        spans = [s.split(":") for s in found[k]["spans"].split(",") if s]
        hits.setdefault((kind, telling > 0), []).append(any(int(b) < at + n and int(e) > at for _, b, e in spans))
    share = {k: sum(v) / len(v) for k, v in hits.items()}
    assert all(v >= 0.9 for (_, good), v in share.items() if good), share
    # twice eight digits may pass as a card, and a wrong card in fours as a phone number
    assert all(v <= 0.1 for (kind, good), v in share.items() if not good and kind not in ("phone", "card")), share
    df = spark.createDataFrame([(1, "host fe80::1 is up"), (2, "my number is 030 1234 5678"), (3, "key = 123e4567-e89b-12d3-a456-426614174000"), (4, "call std::abc::def or a::b"), (5, "uuid 123e4567-e89b-12d3-a456-426614174000")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark, df).collect()}
    assert got == {1: "ip:5:12", 2: "phone:13:26", 3: "secret:6:42", 4: "", 5: ""}


def test_pii_redaction_row_by_row(spark):
    """Null ids, shared ids and clashing names: each row is redacted by its own spans, and nothing else changes."""
    rows = [(None, "mail a@b.org now", 16, "x"), (7, "call +1 (375) 555-0007", 22, None), (7, "or mail u7@x.org", 16, "y"), (8, None, None, "z"), (9, "plain", 999, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string").withColumn("_text", F.lit("clash"))
    got = {tuple(r) for r in pii.redact(spark, df).collect()}
    assert got == {(None, "mail [EMAIL] now", 16, "x", "clash"), (7, "call [PHONE]", 12, None, "clash"), (7, "or mail [EMAIL]", 15, "y", "clash"), (8, None, None, "z", "clash"), (9, "plain", 999, "w", "clash")}


@pytest.mark.parametrize("fan", [16, 2])
def test_pii_running_values_of_long_arrays(spark, fan, monkeypatch):
    monkeypatch.setattr(pii, "_FAN", fan)
    n = (1 << 20) + 50
    ones = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.lit(1))
    if fan == 16:
        last = spark.range(1).select(F.element_at(pii._running(ones, pii._total), -1).alias("n")).first()
        assert last["n"] == n
    values = [(7919 * j * j) % 101 for j in range(100)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    r = df.select(pii._running(F.col("v"), pii._total).alias("a"), pii._running(F.col("v"), lambda p: F.least(*p), left=False).alias("b")).first()
    assert r["a"] == [sum(values[: k + 1]) for k in range(100)] and r["b"] == [min(values[k:]) for k in range(100)]


def test_pii_running_values_as_they_are(spark):
    from itertools import accumulate

    values = [(7919 * j * j) % 101 for j in range(40_000)]
    df = spark.createDataFrame([(values,), (values[:129],), (values[:128],), ([],)], "v array<int>")
    for v, a, b in df.select("v", pii._running(F.col("v"), pii._total).alias("a"), pii._running(F.col("v"), lambda p: F.least(*p), left=False).alias("b")).collect():
        assert a == list(accumulate(v)) and b == list(accumulate(v[::-1], min))[::-1]


# --- 3


def test_substring_dedup(spark, docs):
    first, want = {}, {}
    for i, t in enumerate(texts()):
        w = re.findall(SPACED, t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_duplicate_spans(spark, docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 500
    for name, odd in odd_tables(spark, docs).items():
        assert substring_dedup.remove_duplicate_spans(spark, odd).count() == odd.count(), name


def test_substring_dedup_repeats_within_a_document(spark):
    """A section that its own document repeats, with a passage of an earlier document in it, loses the passage each time."""
    words = lambda name, n: [f"{name}{(j * 7919 + j * j * 31) % 99991}" for j in range(n)]
    rows = []
    for k, n in enumerate((50, 55, 70, 200)):
        passage = words(f"p{k}x", n)
        section = words(f"a{k}x", 80) + passage + words(f"b{k}x", 80)
        rows += [(2 * k, words(f"c{k}x", 60) + passage + words(f"d{k}x", 60)), (2 * k + 1, section * 3)]
    first, want = {}, {}
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        want[i] = (sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_duplicate_spans(spark, docs).collect()}
    assert got == want and [want[2 * k + 1][0] for k in range(4)] == [150, 165, 210, 600]


def test_greedy_factors(spark):
    """The factor sequence of small documents: longest runs in a source, one after the other, and windows across their ends."""
    words = lambda name, n: [f"{name}{(j * 7919 + j * j * 31) % 99991}" for j in range(n)]
    a, b, c, d = (words(k, n) for k, n in (("a", 120), ("b", 90), ("c", 70), ("d", 30)))
    rows = [(1, a + c), (2, b + d), (3, d + a[20:] + b + c), (4, words("x", 5) + a[:49] + d + b[10:70] + a[60:109]), (5, a[90:] + c[:40])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = by_id(substring_dedup.remove_duplicate_spans(spark, docs))
    factors = {i: [tuple(f) for f in r["factors"]] for i, r in got.items()}
    assert factors == {1: [], 2: [], 3: [(30, 100, 1, 20), (130, 90, 2, 0), (220, 70, 1, 120)], 4: [(84, 60, 2, 10)], 5: [(0, 70, 1, 90)]}
    assert got[3]["kept"] == " ".join(d) and got[5]["kept"] == ""
    assert substring_dedup.parse([(0, 11, 1, 0), (30, 5, 2, 7), (45, 60, 3, 9)]) == ([(0, 60, 1, 0), (60, 94, 3, 24)], [(30, 84)])


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Rows with one doc_id keep their own texts, are not earlier than each other, and a short one does no harm."""
    words = lambda name, n: [f"{name}{(j * 7919 + j * j * 31) % 99991}" for j in range(n)]
    p, q = words("p", 60), words("q", 60)
    rows = [(1, p), (2, p + q), (2, q), (2, ["short"]), (2, p + q), (None, p), (3, q + ["end"]), (3, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").withColumn("content", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.remove_duplicate_spans(spark, docs).collect())
    assert got == sorted([("1", 60, 0), ("2", 120, 60), ("2", 60, 0), ("2", 1, 0), ("2", 120, 60), ("None", 60, 0), ("3", 61, 60), ("3", 0, 0)])


# --- 4


def test_quality_statistics(spark, docs):
    got = by_id(quality_rules.judge(spark, docs))
    for i, t in enumerate(texts()):
        t = t or ""
        w = re.findall(SPACED, t)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n, hit = Counter(grams), [False] * len(w)
        for j, g in enumerate(grams):
            if n[g] > 1:
                hit[j : j + 5] = [True] * 5
        lines = [x for x in t.split("\n") if re.search(SPACED, x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit)), i
        assert r["base_failed"] == (len(w) < 10 or 100 * sum(hit) > 20 * len(w))
    for name, odd in odd_tables(spark, docs).items():
        assert quality_rules.judge(spark, odd).count() == odd.count(), name


def test_line_frequency(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(k, f"Common  LINE of all the pages here today\n{body(k)}", "h") for k in range(40)]
    rows += [(100, "common line of all the pages here today\nonly six more words in here", "h"), (101, body(101), "h")]
    rows += [(200 + k, f"copied text {body(7)}\n{body(8)}", "h") for k in range(30)]  # copies of one text are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = by_id(quality_rules.judge(spark, df))
    assert not got[100]["kept"] and got[101]["kept"] and all(got[k]["kept"] for k in [*range(40), *range(200, 230)])
    cleaned = by_id(quality_rules.apply_rules(spark, df))
    assert cleaned[3]["text"] == body(3) and cleaned[3]["n_chars"] == len(body(3)) and 100 not in cleaned and cleaned[205]["text"] == rows[47][1]


def test_null_host_and_long_repetition(spark):
    """A null host is not the empty host; repeats in a text of many words are found at any place."""
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(k, f"shared line of these pages here\n{body(k)}", None if k < 8 else "") for k in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["text"].startswith("shared") for r in quality_rules.apply_rules(spark, df).collect())
    far = " ".join(f"a{k}" for k in range(30_000))
    long_ = spark.createDataFrame([(1, f"p q r s t {far} p q r s t", "h"), (2, "x " * 30_000, "h")], "doc_id long, text string, source string")
    got = by_id(quality_rules.judge(spark, long_))
    assert (got[1]["n_repeat_words"], got[2]["n_repeat_words"]) == (10, 30_000)


def test_one_line_one_verdict_on_every_host(spark):
    """A line in as many documents of a large host as of a small one is cut on both; at the limit it stays on both."""
    body = lambda h, k: " ".join(f"w{h}x{k}x{j}" for j in range(20))
    rows = []
    for h, size in enumerate((12, 40, 400)):
        for k in range(size):
            line = "common line of these pages\n" * (k < 11) + "rarer line of these pages\n" * (k < 10)
            rows.append((1000 * h + k, line + body(h, k), f"h{h}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = by_id(quality_rules.apply_rules(spark, df))
    assert len(cleaned) == len(rows)
    for h in range(3):
        assert cleaned[1000 * h + 3]["text"] == "rarer line of these pages\n" + body(h, 3), h


@pytest.mark.parametrize("count", [12, 1000])
def test_one_of_many_near_copies_stays(spark, count):
    """Each near copy has a line of its own instead of one of the common ones; other documents of the host are judged as before."""
    lines = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(30)]
    rows = [(i, "\n".join(f"own line of {i} alone it is" if k == i % 30 else x for k, x in enumerate(lines)), "h") for i in range(3, 3 + count)]
    rows += [(-1, "\n".join([lines[0], lines[1], "few words more"]), "g"), (9999, "\n".join([lines[5], lines[6], "few words more"]), "h"), (9998, " ".join(f"z{k}" for k in range(40)), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = by_id(quality_rules.apply_rules(spark, df))
    assert set(kept) == {-1, 3, 9998} and kept[3]["text"] == rows[0][1]
    again = by_id(quality_rules.apply_rules(spark, df.unionByName(df.where("doc_id = 3"))))  # a copy of the first is the first text, too
    assert set(again) == {-1, 3, 9998}


def test_column_names_that_clash(spark, monkeypatch):
    """Columns named as the operators' own ones take no part and come back as they were."""
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 2)
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(k, f"common line of all the pages here\n{body(k)}", "h") for k in range(14)] + [(20, "too short", "h"), (21, body(3) + " more", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = df.withColumns({c: F.lit(7) for c in ("_row", "_ROW_", "_cut", "row", "cut", "words", "content", "first", "host", "line")})
    items = spark.createDataFrame([(1, body(3)), (2, body(4))], "item_id long, text string")
    for f in (lambda x: quality_rules.apply_rules(spark, x), lambda x: decontaminate.decontaminated(spark, x, items)):
        got, want = f(odd), f(df)
        assert got.columns == odd.columns and {r["_row"] for r in got.collect()} == {7}
        assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, want.collect())) and 0 < want.count() < len(rows)
    for f in (lambda x: quality_rules.judge(spark, x).select("doc_id", "kept", "n_words"), lambda x: decontaminate.contamination(spark, x, items).select("doc_id", "n_hit", "items_sha256")):
        assert sorted(map(tuple, f(odd).collect())) == sorted(map(tuple, f(df).collect()))


# --- 5


def test_html(spark):
    model = html_text.train(html_text.labelled_pages())
    page = '<html><head><title>t</title><style>p{x}</style></head><body><script>var a="<p>no</p>"</script><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n  text<br>goes on<p>Second &lt;p&gt; one</article><aside class=sidebar><p>Side text here</p></aside><section class="comments"><p>I disagree with all of it, said a reader.</p></section><footer>&copy; all</footer>'
    assert html_text.extract(page, model) == "Title & more\nFirst bold text goes on\nSecond <p> one"
    for odd in ("", "<", "<p", "<<>><p>", "</p></p>", "<!-- x", '<p class="a>b', "<div>" * 5000 + "deep", "&#0;&bogus;", "text only " * 5000):
        html_text.extract(odd, model)
    rows = [(1, "u", page), (2, None, None), (2, "v", ""), (None, "w", page)]
    got = html_text.extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == 4 and got[1]["text"] == "" and got[0]["n_chars"] == len(got[0]["text"])
    assert html_text.extract_pages(spark, spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_html_raw_text_and_open_head():
    model = html_text.train(html_text.labelled_pages())
    article = "<article><h1>Title of the page</h1><p>The first paragraph of it is here.</article>"
    want = "Title of the page\nThe first paragraph of it is here."
    scripts = ["for(i=0;i<n;i++){f(i)}", "if(a<b&&c>'d'){x=\"<p\"}", "<!-- if(a<b) \n//-->", "<!-- w('<script>x<y</script>') -->", "a<!--b", "x='</scripty>'"]
    for code in scripts:
        assert html_text.extract(f"<html><head><script>{code}</script></head><body><script>{code}</SCRIPT >{article}</body></html>", model) == want, code
    for raw in ("<style>a<b{c:d}</style>", "<title>1 <two 'three</title>", "<textarea>x<y 'z</textarea>", "<noscript><img src='x></noscript>", "<svg><svg/><path d=x /></svg>", "<template><p>no text of the page here</p></template>"):
        assert html_text.extract(f"<body>{raw}{article}", model) == want, raw
    assert html_text.extract(f"<html><head><title>t</title><meta charset=utf-8><body>{article}", model) == want
    assert html_text.extract(f"<head><title>t</title><link rel=x href=y>{article}", model) == want
    assert html_text.extract(f"<body>{article}<script>var x = '<p>no text here, either</p>'", model) == want


def test_html_attributes_and_open_elements():
    model = html_text.train(html_text.labelled_pages())
    want = "Title of the page\nThe first paragraph of it is here.\nAnd a second one that ends it."
    page = lambda x: f"<body><nav><a href=x>Home</a></nav><article><h1>Title of the page</h1><p>The first paragraph of it is here.{x}<p>And a second one that ends it.</article><footer>&copy; all</footer>"
    for odd in ("<select><option>", "<button>", "<svg/>", "<template>", "<object data=x>", "<canvas>", "<video src=x>", "<math/>", "<script src=/a/>var x = 1;</script>", "<style/>p{x}</style>", "<select><select><option>1</select>"):
        assert html_text.extract(page(odd), model).startswith("Title of the page\nThe first paragraph of it is here.") and "ends it." in html_text.extract(page(odd), model), odd
    for tag in ("<p class=x\">", "<p class='a>b'>", '<p title="1 > 0" x>', "<p x=y' z>", '<p "">', "<p a=1/2>"):
        text = 'Second "para" with text'
        got = html_text.extract(f"<article><h1>Title of the page</h1>{tag}{text}</p><p>It's the 'last' paragraph.</p></article>", model)
        assert got == f"Title of the page\n{text}\nIt's the 'last' paragraph.", tag
    assert html_text.extract("<article>text <div>and a div</div> tail</article>", model) == "text\nand a div\ntail"
    assert html_text.extract(page(""), model) == want


def test_html_open_elements_in_linear_time():
    import time

    model = html_text.train(html_text.labelled_pages())
    page = lambda n: "<article><p>The first paragraph of it is here.</p>" + "<div>" * n + "</p></section>" * n + "<li>" * n + "<td>" * n + "deep text of the page"
    took = []
    for n in (10_000, 100_000):
        began = time.thread_time()
        assert len(html_text.parse(page(n))) == 3 * n + 5
        took.append(time.thread_time() - began)
    assert took[1] < 30 * took[0] + 2
    assert html_text.extract("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", model) is not None
    kinds = lambda h: [(n.kind, n.parent) for n in html_text.parse(h)]
    assert kinds("<ul><li>a<ul><li>b<li>c</ul><li>d") == [("body", -1), ("list", 0), ("item", 1), ("leaf", 2), ("list", 2), ("item", 4), ("leaf", 5), ("item", 4), ("leaf", 7), ("item", 1), ("leaf", 9)]


def test_html_class_words_that_mislead():
    """A word of a class alone takes no article away, and what is around it still goes."""
    model = html_text.train(html_text.labelled_pages())
    for own in ("bottom-margin content", "tag-news post tags", "bottom-margin", "has-sidebar", "entry share-enabled", "article-with-ads", "content", "", "post format-notice tags"):
        for tag in ("article", "main", "div"):
            html = f'<body><nav class="main-nav"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><{tag} class="{own}"><h1>Title of the page</h1><p>The first paragraph of it is here, and long enough.</p><p>And a second one that ends it for good.</p></{tag}><div class="left-sidebar"><h3>More</h3><ul><li><a href=z>Other story</a></ul></div><div class="site-footer"><p>All rights kept</p></div></body>'
            assert html_text.extract(html, model) == "Title of the page\nThe first paragraph of it is here, and long enough.\nAnd a second one that ends it for good.", (tag, own)


def test_html_text_of_random_pages(spark):
    """Pages put together at random, whose main text is known: the query's text is that text, whatever markup stands around and in it."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeéñ&") for _ in range(rng.randint(1, 7)))
    plain = lambda n: " ".join(word() for _ in range(n))
    code = lambda t: t.replace("&", "&amp;")

    def inline(t):
        out = []
        for w in t.split(" "):
            w = code(w)
            out.append(rng.choice([w, w, w, f"<b>{w}</b>", f'<a href="/x">{w}</a>', f"<em class=note>{w}</em>", f"<span>{w}</span>", f"<!-- {w} -->{w}"]))
        return rng.choice([" ", "\n  ", " "]).join(out)

    noise = ['<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<div class="cookie-banner"><p>We use cookies to count visits.</p></div>', '<aside class="sidebar"><h3>More</h3><ul><li><a href="/q">Next story</a></li></ul></aside>', "<script>for(i=0;i<n;i++){x()}</script>", '<div class="advert"><p>Buy now and save a lot of money today.</p></div>', "<style>p > a { color: red }</style>", '<form class="newsletter"><p>Your address</p><input name=a><button>Go</button></form>']
    rows = []
    for k in range(60):
        title, parts = plain(rng.randint(3, 8)), [plain(rng.randint(12, 80)) for _ in range(rng.randint(2, 7))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p class=lead>{}</p>\n"]).format(inline(t)) + rng.choice(["", "", noise[3], noise[5]]) for t in parts)
        page = f"<html><head><title>{code(title)}</title></head><body>{''.join(rng.sample(noise, 3))}<article><h1>{inline(title)}</h1>{body}</article>{''.join(rng.sample(noise, 3))}<footer><p>All rights kept</p></footer></body></html>"
        rows.append((k, f"http://x/{k}", page, "\n".join([title, *parts])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract_pages(spark, pages.unionByName(pages.where("page_id = 3")).unionByName(pages.where("page_id = 4").selectExpr("99L page_id", "url", "repeat(html, 300) html", "text", "n_chars"))).collect()}
    for k, _, _, text in rows:
        assert got[k]["text"] == text and got[k]["n_chars"] == len(text), k
    assert got[99]["n_chars"] >= 300 * len(rows[4][3])


def test_html_held_out():
    pages = html_text.labelled_pages()
    right = total = 0
    for k in range(0, len(pages), 3):  # each layout is left out once
        model = html_text.train(pages[:k] + pages[k + 3 :])
        for page in pages[k : k + 3]:
            nodes = html_text.parse(page)
            text = html_text._texts(nodes)
            chance = model.marginals(nodes, html_text._looks(nodes, text))
            state = [n.label for n in nodes]
            for i, n in enumerate(nodes):
                state[i] = state[n.parent] if state[i] is None and n.parent >= 0 else state[i]
                if n.kind == "leaf" and text[i] and state[i] is not None:
                    total += 1
                    right += (chance[i] > 0.5) == bool(state[i])
    assert right / total > 0.85


def test_marginals_against_enumeration():
    import itertools
    import math

    model = html_text.train(html_text.labelled_pages())
    nodes = html_text.parse("<article><p>some words</p><div class=ad><p>buy</p></div></article><footer>x</footer>")
    looks = html_text._looks(nodes, html_text._texts(nodes))
    total, mass = 0.0, [0.0] * len(nodes)
    edge = [model.edge.get(f"{nodes[n.parent].kind}>{n.kind}") or model.edge.get(n.kind) for n in nodes]
    for state in itertools.product((0, 1), repeat=len(nodes)):
        p = model.root[state[0]] + sum(model.seen.get(x, (0, 0))[s] for x, s in zip(looks, state))
        p = math.exp(p + sum(edge[i][state[n.parent]][state[i]] for i, n in enumerate(nodes) if i))
        total += p
        mass = [m + p * s for m, s in zip(mass, state)]
    assert model.marginals(nodes, looks) == pytest.approx([m / total for m in mass])


# --- 6, 7


def test_token_files(spark, docs, tmp_path):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(token_files.FILE))
    folder = f"file://{tmp_path}/tokens"
    index = token_files.write_tokens(spark, docs, folder)
    at, want = 0, {}
    for i, t in enumerate(texts()):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_tokens(spark, folder).collect()}
    assert got == want and index["ids"] == at and index["kind"] == "<u2"
    for name, odd in odd_tables(spark, docs).items():
        folder = f"file://{tmp_path}/{name.replace(' ', '-')}"
        token_files.write_tokens(spark, odd, folder)
        assert token_files.read_tokens(spark, folder).count() == odd.count(), name


def test_token_files_of_another_tokenizer(spark, docs, tmp_path):
    import public_tokenizers as P

    folder = f"file://{tmp_path}/words"
    token_files.write_tokens(spark, docs, folder, P.path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, folder).count() == docs.count()


def test_bpe(spark, docs, monkeypatch):
    import base64

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_documents(spark, docs))
    for i, t in enumerate(texts()):
        ids = own.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(spark, bpe.encode_documents(spark, docs))
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts())}
    for piece, run in ((40, 100_000), (40, 30)):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "LONG_RUN", run)
        for t in [*texts(), "a  b \n\n  c\t d" * 30, " " * 500 + "x", "x" + " " * 500]:
            assert bpe.encode(t or "", P.path(bpe.RANKS), P.PATTERN) == own.encode_ordinary(t or "")
    for name, odd in odd_tables(spark, docs).items():
        assert bpe.encode_documents(spark, odd).count() == odd.count(), name


# --- 8, 9


def test_url_filters(spark, monkeypatch):
    canon = '<head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://A.example.com/x#t", canon.format("http://b.example.net/q")), (2, "http://b.example.net/q", None), (3, "http://c.io/a", '<head><meta http-equiv="refresh" content="0; url=http://a.example.com/x"></head>'),
        (4, None, None), (5, "nourl", "x"), (6, "http://d.io/z", canon.format("http://e.example.net/en/k")), (7, "http://f.io/z", canon.format("http://d.io/z") + canon.format("http://g.net/")),
        (8, "http://www.example.com/de/1?x", None), (9, "http://net/", ""), (10, "http://xexample.net.org/fr/", None), (10, "http://h.net", None), (None, "http://i.net/?q", "rel=canonical"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def verdicts():
        return sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark, pages, url_filters.RULES).collect()), key=str)

    got = verdicts()
    assert {x[0]: x[4] for x in got if x[0] in range(1, 10)} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block"}
    assert (10, "xexample.net.org", "/fr/", "org/fr/", "allow") in got and (10, "h.net", "", None, "allow") in got and (0, "i.net", "/", "net/", "block") in got
    monkeypatch.setattr(url_filters, "INLINE_RULES", 0)
    assert verdicts() == got
    assert url_filters.judge_urls(spark, pages.limit(0), url_filters.RULES).count() == 0
    moved = spark.createDataFrame([("http://j.io/", "http://k.net/"), (None, "x")], "a string, b string")
    one = spark.createDataFrame([(1, "http://j.io/", None)], "page_id long, url string, html string")
    monkeypatch.undo()
    assert url_filters.judge_urls(spark, one, url_filters.RULES, moved).first()["verdict"] == "block"


def test_url_links(spark, tmp_path):
    """Links of every form reach the page's aliases; the SQL statement finds the same."""
    import duckdb

    rows = [
        (1, "http://a.io/x/y?q", '<head><link href="/rel/1" rel=canonical></head>'), (2, "http://a.io/rel/1", '<script>"</head>"</script><meta content="0;url=\'//b.net/z\'" http-equiv=Refresh>'),
        (3, "https://c.io", "<link rel='canonical' href='sub/page'>"), (4, "https://c.io/sub/page", '<body></head><meta http-equiv="refresh" content="5; URL=http://example.com/de/1?a&amp;b">'),
        (5, "http://d.io/k", '<!-- <link rel="canonical" href="http://z.net/"> --><link rel="stylesheet" href="http://z.net/">'), (6, "http://e.io/p", '<link rel="canonical" href="#top"><meta http-equiv="refresh" content="30">'),
        (7, "http://f.io/p/q", '<link rel="canonical" href="?v=1">'), (8, "http://f.io/p/q?v=1", '<link rel="canonical" href="mailto:x@z.net">'), (9, None, '<link rel="canonical" href="/x">'),
        (10, "http://g.io", '<link rel="canonical" href="http://z.net">'), (11, "http://g.io/#frag", None), (12, "http://h.io/", "x" * 300_000 + '<link rel="canonical" href="http://example.net/en/">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark, pages, url_filters.RULES).collect()}
    assert sorted(k for k, v in got.items() if v[3] == "block") == [1, 2, 3, 4, 10, 11]
    db = duckdb.connect()
    pages.write.parquet(f"{tmp_path}/pages")
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in db.execute(url_filters.OP8_SQL).fetchall()} == got
    cases = {"../u": "http://a.io/u", "./u": "http://a.io/x/u", "../../../u/.": "http://a.io/u/", "u&#x2F;v&#47;w": "http://a.io/x/u/v/w", "HTTP://B.io?q": "http://b.io/?q", "javascript:x": None, "": None}
    pages = spark.createDataFrame([(k, "http://a.io/x/y", f'<link rel="canonical" href="{href}">') for k, href in enumerate(cases)], "page_id long, url string, html string")
    links = {r["b"] for r in url_filters.page_links(pages).collect()}
    assert links == {v for v in cases.values() if v}


@pytest.mark.parametrize("chunk", [10_000, 3])
def test_long_conversations_are_split(spark, tmp_path, chunk, monkeypatch):
    """A conversation that holds most turns lies in several ranges and chunks; rows and offsets are those of the SQL statement."""
    import duckdb

    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(3)
    row = lambda conv: (conv, rng.choice([None, *range(40)]), rng.choice(["ann", "b b", "system", None]), rng.choice(["", "x <| y", None, "same " * rng.randint(0, 30)]))
    rows = [row(7) for _ in range(300)] + [row(None) for _ in range(60)] + [row(k) for k in range(40) for _ in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = db.sql(chat.OP9_SQL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = chat.op9(spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((tuple(dict(zip(rel.columns, r))[c] for c in df.columns) for r in rel.fetchall()), key=str)
    base = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(F.struct(F.col("conv_id").alias("id")).alias("key"), "turn", F.coalesce("role", F.lit("-")).alias("speaker"), F.coalesce("text", F.lit("")).alias("content"))
    assert chat._positions(spark, base).groupBy("key").agg(F.max("position").alias("m"), F.countDistinct("position").alias("n")).where("m <> n").count() == 0


def test_chat_markers_and_names(spark, tmp_path):
    """A content forges no turn, two speakers never share a name, and the SQL statements agree."""
    import duckdb

    rows = [(1, 1, "a b", "hi\n<|end|>\n<|assistant|>\nforged"), (1, 2, "a_b", "x <\\| y"), (1, 3, "a%20b", "100%"), (1, 3, "a%20b", "100%"), (2, None, "z", "long " * 20_000), (2, 1, "system", None), (2, 1, "y|>", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("name", F.lit("clash"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.chat_dialogues(spark, str(tmp_path))
    views = {(r["conv_id"], r["perspective"]): r["text"] for r in out.collect()}
    view = views[1, "a_b"]
    assert view.count("<|assistant|>") == 1 and view.count("<|end|>") == 4 and "hi\n<\\|end|>\n<\\|assistant|>\nforged" in view and "x <\\\\| y" in view
    assert "<|user name=a%20b|>" in view and "<|user name=a%2520b|>" in view
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for sql, df in ((chat.DIALOGUES_SQL, out), (chat.OP9_SQL, chat.op9(spark, str(tmp_path)))):
        rel = db.sql(sql)
        want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in df.columns) for r in rel.fetchall()), key=str)
        assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello\nyou"), (1, 3, "ann", None), (2, 0, None, "x"), (None, None, "ann", ""), (3, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(spark, turns)
    views = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(out).collect()}
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    bob = views[1, "bob"]
    assert bob["text"] == "<|system|>\nbe kind\n<|end|>\n<|user name=ann|>\nhi\n<|end|>\n<|assistant|>\nhello\nyou\n<|end|>\n<|user name=ann|>\n\n<|end|>\n"
    assert [bob["text"][m["start"] : m["stop"]] for m in bob["mask"]] == ["hello\nyou\n<|end|>\n"]
    assert chat.rotate(spark, turns.limit(0)).count() == 0


# --- 10


def _groups(plain):
    sets = []
    for t in plain:
        w = re.findall(SPACED, (t or "").translate(LOWER))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(plain)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    sizes, root = _groups(texts())
    got = by_id(near_dedup.near_duplicates(spark, docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(root))] == [(n, r, r == i) for i, (n, r) in enumerate(zip(sizes, root))]
    if block == 512:
        odd = odd_tables(spark, docs)
        for name in ("empty", "twice", "null text"):
            assert near_dedup.near_duplicates(spark, odd[name]).count() == odd[name].count(), name
        assert near_dedup.near_duplicates(spark, odd["null id"]).count() == 0


def test_near_copies_of_one_text(spark, monkeypatch):
    """A group of near copies, many of which are linked only through others."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    plain = []
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        plain.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_duplicates(spark, df).orderBy("doc_id").collect()] == _groups(plain)[1]


def test_near_duplicates_without_a_name(spark, docs):
    nameless = docs.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))
    rows = near_dedup.near_duplicates(spark, docs.unionByName(nameless), nameless=True).collect()
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None) == [(n, None, True) for n in sorted(_groups(texts()[:4])[0])]
    assert [r["component_id"] for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])] == _groups(texts())[1]


def test_rows_of_one_id_and_several_texts(spark):
    """Each text of an id is compared by itself, and what any of them links to is one component."""
    rng = random.Random(12)
    base = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(120)] for k in "abcd"}
    near = lambda k, *at: " ".join("changed" if i in at else w for i, w in enumerate(base[k]))
    rows = [(1, near("a")), (1, near("b")), (1, near("b")), (2, near("a", 60)), (3, near("b", 60)), (4, near("c")), (5, near("c", 7)), (6, near("d")), (7, near("d")), (7, near("c", 110)), (9, near("d", 3)), (8, "x"), (8, near("d", 9)), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark, df).collect())
    assert got == sorted([*((i, 1) for i in (1, 1, 1, 2, 3)), *((i, 4) for i in (4, 5, 6, 7, 7, 8, 8, 9)), (8, 8)])


@pytest.mark.parametrize("block, star", [(512, 4096), (7, 5)])
def test_chained_texts_that_are_not_alike(spark, block, star, monkeypatch):
    """Texts that share half of their words: many candidates, few links, some of them only between texts that are not the hub."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dedup, "STAR_DOCS", star)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    plain = []
    for k in range(60):
        at = rng.randrange(20, 40)
        t = base[:at] + [f"o{k}x{j}" for j in range(rng.randint(4, 18))] + base[at:]
        plain += [" ".join(t), " ".join([*t, "more"])] if k % 4 == 0 else [" ".join(t)]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    root = _groups(plain)[1]
    assert [r["component_id"] for r in near_dedup.near_duplicates(spark, df).orderBy("doc_id").collect()] == root
    assert 10 < len(set(root)) < len(plain)


def test_sketch_estimates_similarity():
    import numpy as np

    from alphaloom.llm.words import mix

    for shared, own in ((1, 0), (3, 1), (60, 20), (2000, 300)):
        same = []
        for seed in range(30):
            x = mix(np.arange(1, shared + 2 * own + 1, dtype=np.uint64) + np.uint64(10_000 * seed))
            a, b = np.sort(x[: shared + own]), np.sort(np.concatenate((x[:shared], x[shared + own :])))
            same.append(float(np.mean(near_dedup.sketch(a) == near_dedup.sketch(b))))
        assert np.mean(same) == pytest.approx(shared / (shared + 2 * own), abs=0.06)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, k) for k in range(401, 460)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a in root and b in root and None not in (a, b) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    got = components(spark, spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"]: r["component"] for r in got.collect()} == root
    assert components(spark, spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_blocks_of_like_set_sizes(spark, monkeypatch):
    """Texts of many lengths in the same buckets: prefixes of one text, linked in a chain by length, and again without the links between."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    words = [f"w{k}" for k in range(900)]
    sizes = [*range(5, 60, 3), *(int(60 * 1.05**k) for k in range(40)), 600, 603, 852, 860]
    plain = [" ".join([*words[:n], *(f"{n}o{j}" for j in range(n // 30))]) for n in sizes if n <= 900]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string").repartition(3)
    root = _groups(plain)[1]
    assert [r["component_id"] for r in near_dedup.near_duplicates(spark, df).orderBy("doc_id").collect()] == root
    # what the hubs link is left out: blocks alone find all links
    monkeypatch.setattr(near_dedup, "_star_links", lambda batches: iter(()))
    assert [r["component_id"] for r in near_dedup.near_duplicates(spark, df).orderBy("doc_id").collect()] == root
    far = df.where("doc_id % 9 = 0")
    kept = [p for k, p in enumerate(plain) if k % 9 == 0]
    assert [r["component_id"] for r in near_dedup.near_duplicates(spark, far).orderBy("doc_id").collect()] == [9 * k for k in _groups(kept)[1]]
