"""Bounded-space online packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import UnitTokenizer, lean, unit_tokenizer
from grainmill.plans.shared import materialise

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("task", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, task long"
BATCH_BYTES = 4_000_000


class Windows:
    """A fixed number of open windows of ``size`` tokens.

    A piece goes whole into the window that it fits best. If it fits none and all windows are in use, the fullest
    one takes as much of the piece as it has room for and is emitted; the rest of the piece is placed again.
    """

    def __init__(self, size: int, most_open: int, first_id: int):
        self.size, self.most_open, self.next_id = size, most_open, first_id
        self.open: list[list] = []  # [room, pieces]; a piece is (doc_id, start, ids, doc_tokens)

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> Iterator[tuple]:
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                yield from self._emit([0, [(doc_id, start, ids[: 4 * self.size], doc_tokens)]])
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most_open:
                best = [self.size, []]
                self.open.append(best)
            take = n if best is not None else 0
            if best is None:
                best = min(self.open, key=lambda w: w[0])
                take = best[0]
            best[1].append((doc_id, start, ids[: 4 * take], doc_tokens))
            best[0] -= take
            start, ids = start + take, ids[4 * take :]
            if not best[0]:
                self.open = [w for w in self.open if w is not best]
                yield from self._emit(best)

    def _emit(self, window: list, still_open: bool = False) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, doc_tokens in window[1]:
            yield doc_id, start, len(ids) // 4, ids, doc_tokens, self.next_id, offset, still_open
            offset += len(ids) // 4
        self.next_id += 1

    def rest(self, still_open: bool) -> Iterator[tuple]:
        """The windows that are still open, fullest first."""
        for window in sorted(self.open, key=lambda w: w[0]):
            yield from self._emit(window, still_open)


def _pieces(batches: Iterator[pa.RecordBatch], encoder: UnitTokenizer, end: bytes, windows: Windows) -> Iterator[tuple]:
    """The pieces of a partition's documents, those in windows that stay open last; words are looked up by slices of texts."""
    for batch in batches:
        for doc_id, ids in zip(batch.column(0), encoder.encode_all(batch.column(1))):
            ids += end
            yield from windows.add(doc_id.as_py(), 0, ids, len(ids) // 4)
    yield from windows.rest(True)


def _batches(rows: Iterator[tuple], task: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size >= BATCH_BYTES:
            yield _batch(held, task)
            held, size = [], 0
    yield _batch(held, task)


def _batch(rows: list[tuple], task: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [task] * len(rows)], SCHEMA)], schema=SCHEMA)


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = True, end_id: int = 0, size: int = 1024, most_open: int = 32, fan_in: int = 64) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``size`` tokens.

    Returns a row per piece: doc_id, start and length (in tokens of its document), ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. Each token of a document, ``end_id`` at its end, lies in one piece.

    Every scan partition keeps ``most_open`` windows at a time; what is open at its end goes to the next level, where
    one task merges the leftovers of ``fan_in`` tasks in the same way, until one task is left. So a task holds at most
    most_open * fan_in windows, and all but the last few sequences are full. Documents are cut only at ``size`` tokens
    and where the fullest window is filled up.

    Null texts count as empty (one token, the end); null ids are kept as null; repeated rows and ids are packed each;
    an empty table gives no rows; other columns are ignored. Texts are encoded by slices, so their length is no limit.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, end = unit_tokenizer(tokenizer, keeps_space), np.array([end_id], "<u4").tobytes()
        yield from _batches(_pieces(batches, encoder, end, Windows(size, most_open, task << 32)), task)

    def merge(level: int, last: bool):
        def run(key, leftover: pd.DataFrame) -> pd.DataFrame:
            group = int(key[0])
            windows = Windows(size, most_open, level << 56 | group << 32)
            rows = []
            for r in pa.Table.from_pandas(leftover, SCHEMA).sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
                rows += windows.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            if last:
                windows.most_open = 0
                pieces = [p for w in sorted(windows.open, key=lambda w: w[0]) for p in w[1]]
                windows.open, windows.most_open = [], 1
                for p in pieces:
                    rows += windows.add(*p)
            return _batch([*rows, *windows.rest(not last)], group).to_pandas(integer_object_nulls=True)

        return run

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    placed = materialise(docs.mapInArrow(lean(place, keeps=True), DDL), "pack")
    done, level = placed.where("not open"), 0
    tasks = placed.where("open").agg(F.max("task")).first()[0]
    leftovers = placed.where("open")
    while tasks is not None:
        level, last = level + 1, tasks < fan_in
        merged = leftovers.groupBy(F.floor(F.col("task") / fan_in).cast("long").alias("into")).applyInPandas(merge(level, last), DDL)
        if last:
            done, tasks = done.unionByName(merged), None
        else:
            merged = materialise(merged, "pack")
            done, leftovers, tasks = done.unionByName(merged.where("not open")), merged.where("open"), tasks // fan_in
    return done.drop("open", "task")
