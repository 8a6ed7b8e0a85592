"""Token ids in bit-packed files.

A file holds whole documents in ascending id order.  Ids take the fewest bits that
hold the vocabulary; blocks of BLOCK ids are padded to a byte, and the file keeps the
byte offset of every block, so a block, or the blocks of one document, can be read and
unpacked alone by numpy.  Layout, all numbers little-endian:

    magic "TOKBITS1", uint32 width, uint32 ids per block
    uint64 documents, ids, blocks
    int64 document id, uint8 id is null, uint64 end (ids up to and with the document)
    uint64 byte offset of each block in the payload, and of its end
    payload

Documents are range-partitioned by id once; a task encodes its range and writes files
of about FILE_IDS ids under their final names, by way of a name of its own attempt, so
a task that runs again leaves the same files.  Only the table of files is collected in
order to number the ids: a row per partition.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from types import ModuleType
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.llm.base import quoted, run_folder, stage

MAGIC, BLOCK, FILE_IDS = b"TOKBITS1", 4096, 1 << 21
CACHED_PIECES, SLICE, ROWS = 500_000, 1 << 20, 1024
SUFFIX = ".tokbits"
# Characters whose class every version of Unicode agrees on: ASCII text, Latin letters, common signs.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_DOUBTFUL = re.compile(f"[^ -~\n\r\t{_LETTERS}\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]")
# Fixed value: the pattern by which byte-level tokenizers split, over these characters.
_PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little")
    return bits.reshape(count, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def to_file(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """The bytes of one file."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[i : i + BLOCK], width) for i in range(0, len(flat), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join(
        [
            MAGIC,
            np.array([width, BLOCK], "<u4").tobytes(),
            np.array([len(doc_ids), len(flat), len(blocks)], "<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.cumsum([len(x) for x in ids], dtype="<u8").tobytes(),
            offsets.tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """Reads a file's bytes; ``ids(start, end)`` unpacks only the blocks it needs."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.width, self.block = (int(x) for x in np.frombuffer(data, "<u4", 2, 8))
        docs, self.count, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 16))
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs).astype(bool)
        self.ends = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [
            unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.count - b * self.block), self.width)
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        start = 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.null.tolist(), self.ends.tolist(), strict=True):
            yield None if null else doc, start, self.ids(start, end)
            start = end


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte, by its rule.

    Visible characters of Latin-1 stand for themselves; the other bytes, in order, for the
    characters from 256 on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes whole texts; each distinct pre-token is encoded once.

    A byte-level tokenizer splits a text into pre-tokens by a pattern and encodes each
    alone by its model.  Texts of characters whose class is beyond doubt are split here,
    by the same pattern, and a pre-token that is new goes to the model; all other texts,
    those that hold an added token, and all texts if the tokenizer is of another kind, go
    to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.model = self.tokenizer.model
        self.splits = (
            parts["normalizer"] is None
            and {k: split.get(k) for k in plain} == plain
            and parts["model"]["type"] == "BPE"
            and not parts["model"].get("dropout")
        )
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def pre_tokens(self, text: str) -> list[str] | None:
        """None if the text has to be encoded whole."""
        if not self.splits or _DOUBTFUL.search(text) or any(a in text for a in self.added):
            return None
        return _PRE_TOKEN.findall(text)

    def _learn(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pre_tokens(t) for t in texts]
        if len(self.known) > CACHED_PIECES:  # what is used again is taken over from the older half
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for piece in set().union(*[c for c in cut if c]).difference(known):
            known[piece] = older.get(piece) or self._learn(piece)
        raw = (self.whole(t) if c is None else b"".join([known[p] for p in c]) for t, c in zip(texts, cut, strict=True))
        return [np.frombuffer(r, np.uint32) for r in raw]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python process for a tokenizer; what it knows serves later tasks too.

    Functions of this package come to a worker by value, once for each task, so the
    encoder is kept where tasks do not replace it.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores have tasks of their own; threads would keep memory each
    kept = sys.modules.setdefault("panelwise_llm_encoders", ModuleType("panelwise_llm_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def vocabulary_bits(path: str, *more_ids: int) -> int:
    from tokenizers import Tokenizer

    return max(1, Tokenizer.from_file(path).get_vocab_size() - 1, *more_ids).bit_length()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    partitions: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write token files into ``folder``; returns (partition, seq, file, docs, ids), a row per file.

    Documents are in ascending id order, null ids first, equal ids in the order of a
    hash of their texts; equal rows are written each.  A null text is an empty one:
    only the end id.  Other columns are left out.  An empty table writes no file.
    ``folder`` must be one that all executors and the driver reach.
    """
    spark = docs.sparkSession
    width = vocabulary_bits(tokenizer, end_id)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = worker_encoder(tokenizer), TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        out, doc_ids, ids, held = [], [], [], 0

        def close() -> None:
            name = f"part-{part:06d}-{len(out):06d}{SUFFIX}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}.{attempt}") as f:
                f.write(to_file(doc_ids, ids, width))
            store.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            out.append((part, len(out), name, len(doc_ids), sum(map(len, ids))))
            doc_ids.clear()
            ids.clear()

        # a batch holds thousands of texts: only a few are Python objects at a time
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            keys = iter(batch.column("id").to_pylist())
            for texts in _slices(batch.column("text").to_pylist()):
                for coded in encoder.encode(texts):
                    doc_ids.append(next(keys))
                    ids.append(np.append(coded, np.uint32(end_id)))
                    held += len(ids[-1])
                    if held >= FILE_IDS:
                        close()
                        held = 0
        if doc_ids:
            close()
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["partition", "seq", "file", "docs", "ids"])

    return stage(rows.mapInArrow(write, "partition int, seq int, file string, docs long, ids long"), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """(file, first): the number of ids in all files before each."""
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = files.groupBy("partition").agg(F.sum("ids").alias("ids"))
    parts = parts.select("partition", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("partition").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(parts, "partition").select(
        "file", (F.col("skip") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("first")
    )


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                rows = [(d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in TokenFile(content.as_py()).documents()]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), *columns], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    if files.isEmpty():
        return spark.sql("SELECT 0L AS doc_id, 0L AS start, 0L AS n_tokens, 0L AS ids_crc32 LIMIT 0")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    found = found.select(F.substring_index("path", "/", -1).alias("file"), "content")
    docs = found.mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(file_starts(files), "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A folder for token files that driver and executors share."""
    return f"{run_folder(spark)}/tokens-{uuid4().hex}"
