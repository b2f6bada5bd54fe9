"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each match of the split pattern is encoded by itself, so a text may be cut wherever two matches
always meet: before a run of white space that follows something else. Long texts are cut there into
pieces of about PIECE characters, which bounds the work of one library call. A stretch of LONG_RUN
characters without such a place (one endless word, or endless white space) is split by the ``regex``
module instead and its matches are encoded one by one. Decoding joins the raw bytes of the ids, so
it gives the text's UTF-8 bytes back.

Defined cases: a null or empty text has no ids and decodes to no bytes; strings that look like
special tokens are ordinary text; repeated rows are encoded each by itself; a null doc_id stays as
it is; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import prepare, table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE, LONG_RUN = 50_000, 200_000


@lru_cache(maxsize=2)
def _coder(ranks: str, pattern: str):
    """The library's encoding, the split pattern with Unicode white space spelt out, and the places where texts may be cut."""
    import regex
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    spelt = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return encoding, regex.compile(spelt), regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


def encode(text: str, ranks: str, pattern: str) -> list[int]:
    """Ids of one text."""
    encoding, matches, places = _coder(ranks, pattern)
    if len(text) <= PIECE:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    while at < len(text):
        place = places.search(text, at + PIECE)
        stop = place.start() if place else len(text)
        part = text[at:stop]
        if len(part) <= LONG_RUN:
            ids += encoding.encode_ordinary(part)
        else:
            for match in matches.finditer(part):
                ids += encoding._encode_single_piece(match[0].encode())
        at = stop
    return ids


def decode(ids: list[int], ranks: str, pattern: str) -> bytes:
    """Raw bytes of ids."""
    return _coder(ranks, pattern)[0].decode_bytes(ids)


def _encoder(ranks: str, pattern: str, with_ids: bool):
    def run(batches):
        for batch in batches:
            counts, marks, backs, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", ranks, pattern)
                raw = np.array(ids, "<u4")
                counts.append(len(ids))
                marks.append(hashlib.sha256(raw).hexdigest())
                backs.append(hashlib.sha256(decode(ids, ranks, pattern)).hexdigest())
                if with_ids:
                    all_ids.append(raw.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, ranks: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    import public_tokenizers

    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts.mapInArrow(_encoder(ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN, with_ids), shape)


def decode_documents(spark: SparkSession, encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The bytes of each row's ids: doc_id, bytes; null ids are an empty text."""
    import public_tokenizers

    prepare(spark)
    ranks, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or [], ranks, pattern) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"), with_ids=False)
