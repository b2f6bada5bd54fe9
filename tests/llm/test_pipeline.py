"""The pipeline's stages take effect, one after the other, and its rows are those of brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from test_operators import PII, SPACED, _contamination, _groups, texts

import corpus_pipeline as pipeline
from alphaloom.llm import bpe


def test_stages(spark, tmp_path):
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + j * j * 31) % 9973}" for j in range(n))
    item = words(99, 20)
    rows = [(1, words(1, 60)), (2, words(1, 60)), (3, words(1, 59) + " changed"), (4, words(4, 60) + " mail a@b.org"), (5, words(5, 30) + " " + item), (6, "too short"), (7, "again and again " * 20), (8, None)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], shape)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    assert [sorted(x) for x in kept.values()] == [[1, 2, 3, 4, 5], [1, 4, 5], [1, 4], [1, 4], [1, 4]]
    assert kept["pii"][4]["text"].endswith("mail [EMAIL]") and kept["pii"][4]["n_chars"] == len(kept["pii"][4]["text"])
    whole = {r["doc_id"]: r["ids_sha256"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in kept["bpe"].items()}


def test_rows_without_or_with_a_shared_id(spark, tmp_path):
    """Each stage judges each row by itself: null ids are kept and treated, texts that share an id are different documents."""
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + j * j * 31) % 9973}" for j in range(n))
    item = words(99, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = lambda k: [words(k, 60), words(k + 1, 30) + " " + item, words(k + 2, 60) + " mail a@b.org", f"too short {k}"]
    rows = [(key, t) for key, k in ((None, 1), (7, 11)) for t in kinds(k)]
    docs = spark.createDataFrame([(key, t, "en", "s", len(t)) for key, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)

    def after(stage, frame=docs):
        return sorted(((r["doc_id"], r["text"]) for r in stages[stage](spark, frame, str(tmp_path)).collect()), key=str)

    assert after("quality_rules") == sorted((r for r in rows if "short" not in r[1]), key=str)
    assert after("decontaminate") == sorted((r for r in rows if item not in r[1]), key=str)
    assert after("pii") == sorted(((i, t.replace("a@b.org", "[EMAIL]")) for i, t in rows), key=str)
    # copies, of which one has no id and one has the largest: the smallest id stays
    copies = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 7 and length(text) > 20").withColumn("doc_id", F.lit(None).cast("long")))
    assert after("near_dedup", copies) == sorted(rows, key=str)


def _quality(rows):
    """(id, host, text) that pass the rules, without boilerplate lines; a line's first text keeps it."""
    words = lambda t: re.findall(SPACED, t)
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    seen = {}
    for _, host, text in rows:
        for line in filter(words, text.split("\n")):
            seen.setdefault((host, norm(line)), {}).setdefault(text, len(seen))
    out = []
    for i, host, text in rows:
        w = words(text)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        times = Counter(windows)
        repeated = {j + k for j, x in enumerate(windows) if times[x] > 1 for k in range(5)}
        common = lambda line: len(seen.get((host, norm(line)), ())) > 10 and next(iter(seen[host, norm(line)])) != text  # noqa: B023, E731
        lines = text.split("\n")
        cut = sum(len(words(x)) for x in lines if common(x))
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and 2 * cut <= len(w):
            out.append((i, host, "\n".join(x for x in lines if not common(x))))
    return out


def test_run_against_brute_force(spark, tmp_path):
    """Whole rows of ``run``, by plain loops over the same documents."""
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, line = text(20), "Read more\there"
    plain = [t or "" for t in texts()]
    plain += [f"{text(40)}\n{line.upper() if k % 2 else line}\n{text(3)}" for k in range(14)]
    plain += ["\n".join([line] * 4 + [text(11)]), "\n".join([text(5)] + [line] * 5)]
    plain += [f"{text(60)} {item} {text(k)}" for k in (5, 80, 900)]
    plain += [f"{text(30)} write to some.one+{k}@mail.example.org or from 10.0.{k}.255 {text(20)}" for k in range(4)]
    rows = [(i, ["a", None, "b"][i % 3] if i < len(texts()) else "h", t) for i, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t, "en", h, len(t)) for i, h, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, plain[11])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = _quality(rows)
    root = _groups([t for *_, t in kept])[1]
    single = [r for k, r in enumerate(kept) if root[k] == k]
    bad = _contamination([(i, t) for i, _, t in single], [(1, item), (2, plain[11])])
    clean = [(i, t) for i, _, t in single if not bad[i][4]]
    assert len(rows) > len(kept) > len(single) > len(clean) > 20
    want = {}
    for i, t in clean:
        t = re.sub(PII["ip"], "[IP]", re.sub(PII["email"], "[EMAIL]", t))
        ids = own.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


def test_column_names_that_clash(spark, tmp_path):
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + j * j * 31) % 9973}" for j in range(n))
    rows = [(1, words(1, 60)), (2, words(1, 60)), (3, words(3, 60)), (4, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("_row", "row", "component_id", "content", "_cut")})
    spark.createDataFrame([(1, words(9, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert {r["_row"] for r in docs.collect()} == {r["component_id"] for r in docs.collect()} == {7}, name
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]


def test_near_copies_pass_to_the_next_stage(spark, tmp_path):
    lines = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(30)]
    texts_ = ["\n".join(f"own line of {i}" if k == i % 30 else x for k, x in enumerate(lines)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts_)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    kept = stages["near_dedup"](spark, stages["quality_rules"](spark, docs, str(tmp_path)), str(tmp_path)).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(0, texts_[0])]


def test_keys_of_rows(spark, tmp_path):
    """Rows of files have keys by their place, rows of anything else written ones: as many as rows, the same in each reading."""
    from alphaloom.llm.common import keyed

    df = spark.range(5000).select((F.col("id") % 7).alias("doc_id"), F.lit("same text").alias("text"), F.lit(7).alias("_row"), F.lit(8).alias("_file"))
    df.repartition(6).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    for docs in (read, read.where("doc_id < 7"), read.select("doc_id", "text", "_row", "_file", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")), df, df.limit(0)):
        rows, key = keyed(spark, docs)
        assert key not in docs.columns and rows.columns == [*docs.columns, key]
        first, again = (sorted(r[0] for r in rows.select(key).collect()) for _ in range(2))
        assert first == again and len(set(first)) == len(first) == docs.count()
    assert "_place" not in keyed(spark, read)[0].columns and keyed(spark, read)[0]._jdf.queryExecution().analyzed().toString().count("rows-") == 0
