"""Quality rules with DataFrame functions only: text statistics and cross-document line frequency.

Statistics need one row each. Repeated five-word windows are found by hashing the words once, then the
windows, and sorting the hashes with their positions: equal windows become neighbours, so
the cost is that of a sort, whatever the repetition. Texts without a repeat, the usual case, end
after one hash-set test.

Line frequency. Each line is normalised (lower case, white space runs as one space, ends trimmed)
and hashed; per host the distinct documents with that line are counted, where copies of one text
count once, so that a text is not held against its own copies. A line in more than MIN_DOCS of them is
boilerplate, but for the first text that holds it (of the smallest doc_id): what near copies share is so kept with
one of them, and the first of any number of near copies loses nothing. The limit is absolute: as a share it would grow with the host, so that a line is cut on
one host and kept on another that has it as often, and a hot host keeps what thousands of its documents
share. A document is depleted, and rejected, when boilerplate holds more than half of its words. Counts are pre-aggregated; a line that every document
has is one key of a join whose other side holds each frequent line once.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of
its own; repeated rows are judged alike, each by itself; a null doc_id is kept as it is; texts
without an id come after all others, in the order of their hashes; other columns, whatever their names, are ignored by ``judge`` and passed through by ``apply_rules``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import fresh, keyed, row_key, table, written

SPACE = r"[\x20\x09-\x0D]"
_BLANK = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT = 10, 20, 5
#: A line is boilerplate in more than this many distinct documents of its host.
MIN_DOCS = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def _repeat_words(words: Column) -> Column:
    """Words in windows of REPEAT words that occur twice or more."""

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("far"))
        return F.aggregate(at, zero, lambda s, p: F.struct((s["n"] + p + REPEAT - F.greatest(p, s["far"])).alias("n"), (p + REPEAT).alias("far")))["n"]

    def repeated(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(order: Column) -> Column:
            found = F.filter(order, lambda x, k: F.coalesce(x["h"] == F.get(order, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(order, k + 1)["h"], F.lit(False)))
            return covered(F.sort_array(F.transform(found, lambda x: x["i"])))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(placed, twins))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - REPEAT), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(REPEAT))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < REPEAT + 1, F.lit(0)).otherwise(_let(hashed, lambda h: _let(windows(h), repeated)))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(F.regexp_replace(F.lower(line), SPACE + "+", " ")))


def statistics(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per document row (``key``: the column that tells rows apart) its statistics, the hash of its text, and for each line with a word its hash and words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(row_key(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    counted = F.transform("lines", lambda x: F.struct(_line_hash(x).alias("line"), F.size(_words(x)).alias("words")))
    base = base.withColumns({"words": _words(F.col("text")), "lines": lines})
    return base.select(
        "row",
        "doc_id",
        "host",
        F.xxhash64("text").alias("content"),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
        counted.alias("counted"),
    )


def boilerplate(stats: DataFrame) -> DataFrame:
    """Lines above the limit: host, line, and the hash of the first text that holds it."""
    seen = stats.select("host", "content", "doc_id", F.explode(F.array_distinct("counted.line")).alias("line"))
    texts = seen.groupBy("host", "line", "content").agg(F.min("doc_id").alias("id"))  # null only if no copy has an id
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "content")
    return texts.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(place)["content"].alias("first")).where(F.col("n") > MIN_DOCS).select("host", "line", "first")


def judge(spark: SparkSession, docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per document row: row (column ``key``, if one is given), its statistics, base_failed, kept, and the hashes of its boilerplate lines (null if none)."""
    stats = written(spark, statistics(docs, key), "lines")
    lines = stats.select("row", "host", "content", F.explode("counted").alias("c")).select("row", "host", "content", "c.line", "c.words")
    cut = lines.join(written(spark, boilerplate(stats), "boilerplate"), ["host", "line"]).where("content <> first").groupBy("row").agg(F.sum("words").alias("cut_words"), F.collect_set("line").alias("cut"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 2 * F.coalesce(F.col("cut_words"), F.lit(0)) > F.col("n_words")
    out = stats.drop("counted", "host", "content").join(cut, "row", "left")
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def apply_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that pass, without their boilerplate lines; all columns stay, n_chars follows the text."""
    rows, key = keyed(spark, docs)
    gone = fresh(rows, "_cut")
    verdict = judge(spark, rows, key).where("kept").select(F.col("row").alias(key), F.col("cut").alias(gone))
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(gone, _line_hash(x)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    out = rows.join(verdict, key).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
