"""Token ids in files of bit or byte planes, each plane of a block compressed by itself."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import lean, unit_tokenizer
from grainmill.plans.shared import materialise, shared_dir

MAGIC = b"GMPLANE1"
BLOCK = 65_536


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The block's 4 byte planes, or its 32 bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of n."""
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class ShardWriter:
    """One file: magic, blocks (planes one after the other), document index, chunk index as JSON, its length, magic.

    The chunk index has each block's place, its planes' compressed lengths and its number of ids.
    """

    def __init__(self, sink, planes: str = "byte", block: int = BLOCK, level: int = 3):
        self.sink, self.planes, self.block = sink, planes, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at = self.sink.write(MAGIC)
        self.pending, self.n_pending, self.chunks = [], 0, []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.block:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        whole = len(ids) if everything else len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            part = ids[k : min(k + self.block, whole)]
            packed = [self.zstd.compress(p) for p in to_planes(part, self.planes)]
            self.chunks.append([self.at, [len(p) for p in packed], len(part)])
            for p in packed:
                self.at += self.sink.write(p)
        self.pending, self.n_pending = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        docs = self.zstd.compress(np.array([d is None for d in self.doc_ids], "u1").tobytes() + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        index = json.dumps({"planes": self.planes, "docs": [self.at, len(docs), len(self.doc_ids)], "chunks": self.chunks}).encode()
        self.sink.write(docs + index + struct.pack("<q", len(index)) + MAGIC)


class ShardReader:
    """Reads a file of ShardWriter; ``ids(a, b)`` decompresses only the blocks that hold that range."""

    def __init__(self, source):
        self.source = source
        end = source.size() - len(MAGIC) - 8
        (n,) = struct.unpack("<q", source.read_at(8, end))
        if source.read_at(len(MAGIC), 0) != MAGIC or source.read_at(len(MAGIC), end + 8) != MAGIC:
            raise ValueError("not a shard of token planes")
        self.index = json.loads(source.read_at(n, end - n))
        at, size, count = self.index["docs"]
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(size, at))
        null, ids = np.frombuffer(raw, "u1", count), np.frombuffer(raw, "<i8", count, count)
        self.doc_ids = [None if z else int(d) for z, d in zip(null, ids)]
        self.lengths = np.frombuffer(raw, "<i8", count, 9 * count)
        self.first = np.concatenate([[0], np.cumsum([c[2] for c in self.index["chunks"]], dtype=np.int64)])
        self._held = (-1, None)

    def _block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            at, sizes, n = self.index["chunks"][k]
            raw, planes = self.source.read_at(sum(sizes), at), []
            for size in sizes:
                planes.append(zstandard.ZstdDecompressor().decompress(raw[:size]))
                raw = raw[size:]
            self._held = (k, from_planes(planes, n))
        return self._held[1]

    def ids(self, a: int, b: int) -> np.ndarray:
        k, parts = int(np.searchsorted(self.first, a, "right")) - 1, []
        while a < b:
            till = min(b, int(self.first[k + 1]))
            parts.append(self._block(k)[a - int(self.first[k]) : till - int(self.first[k])])
            a, k = till, k + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        at = 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            yield doc_id, at, self.ids(at, at + n)
            at += n


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, keeps_space: bool = False, end_id: int = 2, planes: str = "byte", partitions: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids, by ascending doc_id, into shards under ``folder``.

    Returns a row per shard: path, shard, n_docs, n_tokens and first_token (ids in all shards before it). Rows with one
    doc_id are ordered by text; null ids come first; null texts count as empty; each document ends with ``end_id``; an
    empty table gives no shards. Ids are split by ranges of (doc_id, hash of text), so a repeated id can't fill a task.
    A shard is written beside its place and moved there, so a task that runs twice leaves the same file.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/shard-{context.partitionId():06d}.planes"
        aside = f"{name}.{context.taskAttemptId()}"
        encoder, end = unit_tokenizer(tokenizer, keeps_space), np.array([end_id], "<u4").tobytes()
        n_docs = n_tokens = 0
        with files.open_output_stream(aside) as sink:
            shard = ShardWriter(sink, planes)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0), encoder.encode_all(batch.column(1))):
                    ids += end
                    shard.add(doc_id.as_py(), ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4
            shard.close()
        files.move(aside, name)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "shard": pa.array([context.partitionId()], pa.int64()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    shards = materialise(ordered.mapInArrow(lean(write, keeps=True), "path string, shard long, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return shards.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(shards: DataFrame) -> DataFrame:
    """A row per document of those shards: doc_id, start (ids in all documents before it), n_tokens, ids (binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with files.open_input_file(name) as source:
                    for doc_id, at, ids in ShardReader(source).documents():
                        held.append((doc_id, first + at, len(ids), ids.tobytes()))
                        size += ids.nbytes
                        if size > 4_000_000:
                            yield _rows(held)
                            held, size = [], 0
                yield _rows(held)

    n = max(1, shards.count())
    return shards.select("path", "first_token").repartition(n, "path").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*held)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "n_tokens", "ids"])
