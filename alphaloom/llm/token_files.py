"""Token ids as flat files: unsigned integers, 64-bit document offsets, memory-mapped reading.

Layout, for partition k of the documents in ascending doc_id order:
  part-k.bin   ids, little-endian unsigned 16-bit if the vocabulary fits, else 32-bit
  part-k.off   n_docs + 1 little-endian 64-bit offsets, in ids, from the partition's start
  part-k.doc   n_docs little-endian 64-bit doc_ids (the smallest integer stands for null)
  index.json   ids and documents before each partition: prefix sums of the partitions' totals

Documents are range-partitioned by doc_id and a hash of the text, so that an id that many rows share is
split, and sorted; the number of partitions follows the size of the texts. Each task encodes its documents
and writes its own files under a name of its attempt and renames them when they are complete, so a task
that runs again replaces them whole. Only one row per partition goes to the driver. Readers map a file and
never load more than they use. Texts travel rather than ids: finding the ranges would encode everything
twice, or need a table of ids in between, and ids of texts in no language are as long as the texts.

Encoding. The tokenizers library needs about a microsecond a byte, most of it spent on words seen
before. For a byte-level BPE file a batch is cut into chunks, before white space that follows something
else: two matches of the split pattern always meet there. The distinct chunks of a batch are found by
Arrow's dictionary encoding, those not met before are split by the pattern, and the library's model
gets all new pieces in one call, divided by a byte that takes part in no merge. Ids of chunks are kept in a
bounded table per worker, from which a batch's ids are gathered as arrays. Other tokenizer files go to
the library text by text.

Defined cases: a null or empty text is the end id alone; strings that look like special tokens are
ordinary text; documents that repeat a doc_id follow each other; a null doc_id sorts first and comes
back as null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import by_bytes, prepare, shared_dir, table, text_bytes

FILE = "byte_bpe_50k.json"
END = 0
#: Chunks whose ids a worker remembers, and ids that it keeps for them.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 32_000_000
#: Bytes of text that are encoded at once, and that a partition is to have.
AT_ONCE, FILE_BYTES = 8 << 20, 256 << 20
_GROUP = 2000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as little-endian integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        letters = _byte_letters()
        self.known = (
            spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and letters[0] in model["vocab"]
            and not any(letters[0] in "".join(m) for m in model["merges"])
        )
        if self.known:
            self.bare = Tokenizer(self.whole.model)
            self.divider = model["vocab"][letters[0]]
            self.letters = letters
            pattern = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
            self.matches = regex.compile(pattern).findall
            self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, int] = {}
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.bare.encode(text.encode().decode("latin-1").translate(self.letters), add_special_tokens=False).ids, self.kind)

    def _learn(self, pieces: list[str]) -> None:
        odd = [p for p in pieces if "\0" in p]
        for p in odd:
            self.pieces[p] = self._ids(p).tobytes()
        if odd:
            pieces = [p for p in pieces if "\0" not in p]
        for i in range(0, len(pieces), _GROUP):
            group = pieces[i : i + _GROUP]
            ids = self._ids("\0".join(group))
            ends = (np.flatnonzero(ids == self.divider) * self.kind.itemsize).tolist()
            raw, at = ids.tobytes(), 0
            for piece, end in zip(group, [*ends, len(raw)]):
                self.pieces[piece] = raw[at:end]
                at = end + self.kind.itemsize

    def _split(self, chunk: str) -> tuple[str, ...] | list[str]:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return (chunk,)
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return (chunk[:-1], chunk[-1])
        return self.matches(chunk)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each chunk in the table; chunks not met before are added."""
        chunks = self.chunks
        new = [w for w in words if w not in chunks]
        if new:
            split = [self._split(w.decode()) for w in new]
            self._learn(list({p for ps in split for p in ps if p not in self.pieces}))
            piece = self.pieces.__getitem__
            coded = [b"".join(map(piece, ps)) for ps in split]
            chunks.update(zip(new, range(len(chunks), len(chunks) + len(new))))
            self.size = np.append(self.size, np.array([len(c) for c in coded], np.int64) // self.kind.itemsize)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(coded), self.kind))
        return np.fromiter(map(chunks.__getitem__, words), np.int64, len(words))

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: texts, and white space that follows something else."""
        blank = _BLANK[data]
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[0] = False
        at = np.flatnonzero(begin)
        at = at[data[at - 1] >= 0x80]
        if len(at):  # no chunk begins behind white space beyond ASCII
            x, y, z = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
            wide = (y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
            wide |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            begin[at[wide]] = False
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begin)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other and each with the end id, and the offsets of each text's ids."""
        data, offsets = text_bytes(column)
        if not self.known:
            coded = [np.array([*x.ids, END], self.kind) for x in self.whole.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *coded]), np.cumsum([0, *map(len, coded)])
        if len(self.chunks) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self._forget()
        ids, ends = np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        if len(data):
            begin = self._chunks(data, offsets)
            cuts = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
            number = self._numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
            starts = np.cumsum(self.size) - self.size
            size = self.size[number]
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(starts[number] - stop + size, size) + np.arange(stop[-1])]
            ends = np.append(0, stop)[np.searchsorted(begin, offsets)]
        return np.insert(ids, ends[1:], END), ends + np.arange(len(ends))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _storage(uri: str):
    """File system and path of a folder; the folder may be in any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, path: str):
    def run(batches):
        task = TaskContext.get()
        store, root = _storage(folder)
        encode = encoder(path)
        name, mark = f"{root}/part-{task.partitionId()}", f"{task.taskAttemptId()}.tmp"
        offsets, docs, total = [np.zeros(1, "<i8")], [], 0
        with store.open_output_stream(f"{name}.bin.{mark}") as out:
            for batch in batches:
                for part in by_bytes(batch, 1, AT_ONCE):
                    ids, cuts = encode(part.column(1))
                    out.write(ids.astype(encode.kind))
                    offsets.append((total + cuts[1:]).astype("<i8"))
                    total += len(ids)
                docs.append(np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min)).astype("<i8"))
        for suffix, arrays in (("off", offsets), ("doc", docs)):
            with store.open_output_stream(f"{name}.{suffix}.{mark}") as out:
                for a in arrays:
                    out.write(a)
        for suffix in ("bin", "off", "doc"):
            store.move(f"{name}.{suffix}.{mark}", f"{name}.{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([sum(map(len, docs))], pa.int64()), pa.array([total], pa.int64()), pa.array([encode.kind.str])], ["part", "docs", "ids", "kind"])

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None) -> dict:
    """Write the files of all documents and return the index, which is written beside them as index.json."""
    import public_tokenizers

    prepare(spark)
    store, root = _storage(folder)
    store.create_dir(root, recursive=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    mark = F.xxhash64("text")
    dealt = texts.repartitionByRange(count, F.col("doc_id"), mark).sortWithinPartitions(F.col("doc_id"), mark)
    parts = sorted(dealt.mapInArrow(_writer(folder, path or public_tokenizers.path(FILE)), "part int, docs long, ids long, kind string").collect())
    index, docs_before, ids_before = [], 0, 0
    for p in parts:
        index.append({"part": p["part"], "docs": p["docs"], "ids": p["ids"], "docs_before": docs_before, "ids_before": ids_before})
        docs_before, ids_before = docs_before + p["docs"], ids_before + p["ids"]
    out = {"kind": parts[0]["kind"] if parts else "<u2", "end": END, "docs": docs_before, "ids": ids_before, "parts": index}
    with store.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(out).encode())
    return out


def _mapped(store, name: str, kind: str) -> np.ndarray:
    """A file's integers: memory-mapped where the store is local, else read."""
    from pyarrow import fs

    if store.get_file_info(name).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens with the end id, ids_crc32."""
    prepare(spark)
    store, root = _storage(folder)
    with store.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    kind = index["kind"]

    def run(batches):
        store, root = _storage(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{root}/part-{part}"
                offsets, docs, ids = _mapped(store, f"{name}.off", "<i8"), _mapped(store, f"{name}.doc", "<i8"), _mapped(store, f"{name}.bin", kind)
                for at in range(0, len(docs), 10_000):
                    some = docs[at : at + 10_000]
                    edge = np.asarray(offsets[at : at + len(some) + 1])
                    marks = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(some), mask=np.asarray(some) == np.iinfo(np.int64).min), pa.array(base + edge[:-1]), pa.array(np.diff(edge)), pa.array(marks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(p["part"], p["ids_before"]) for p in index["parts"] if p["docs"]]
    parts = spark.createDataFrame(rows, "part int, base long").repartitionByRange(max(1, len(rows)), "part")
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark, table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder)
