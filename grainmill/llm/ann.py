"""Nearest neighbours by an inverted file of product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.vectors import sample, stack, valid_vectors
from grainmill.plans.shared import materialise


def kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centres."""
    rows = rows.astype(np.float32)
    centres = np.unique(rows, axis=0)
    centres = centres[np.random.default_rng(seed).permutation(len(centres))[:k]]
    for _ in range(rounds):
        own = nearest(rows, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres).astype(np.float32)
    return centres


def square_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Up to a term that is the same along a row."""
    return (centres**2).sum(1)[None] - 2 * rows @ centres.T


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([square_distances(rows[i : i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


@dataclass
class Index:
    """Coarse centres, codebooks of the residuals' parts, and how many cells a query visits."""

    centres: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]
    probes: int

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = v.astype(np.float32)
        cell = nearest(v, self.centres)
        residual = v - self.centres[cell]
        return cell, np.stack([nearest(residual[:, p], b).astype(np.uint8) for p, b in zip(self.parts, self.books)], axis=1)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each query's residual parts to the codewords: (queries, parts, 256)."""
        out = np.full((len(residual), len(self.parts), 256), np.inf, np.float32)
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, k, : len(b)] = ((residual[:, None, p] - b[None]) ** 2).sum(2)
        return out


def fit(rows: np.ndarray, n: int, recall: float, k: int, width: int = 2, most_cells: int = 2048) -> Index:
    """Fit on a bounded sample of the n vectors.

    The number of cells is the root of n, more where cells still hold 256 rows, up to ``most_cells``;
    codes have a byte for every ``width`` dimensions. The
    number of probes is the least that reaches ``recall`` of the k nearest neighbours inside the sample, for 200 of its
    rows. The sample is thinner than the whole, its neighbours are further off, so more are visited than need be.
    """
    cells = max(1, min(most_cells, len(rows) // 8, max(round(n**0.5), min(n // 256, round(4 * n**0.5)))))
    centres = kmeans(rows, cells)
    own = nearest(rows.astype(np.float32), centres)
    residual = rows.astype(np.float32) - centres[own]
    parts = [slice(a, min(a + width, rows.shape[1])) for a in range(0, rows.shape[1], width)]
    books = [kmeans(residual[:, p], 256, rounds=5) for p in parts]
    queries = rows[:200].astype(np.float32)
    near = np.argsort(square_distances(queries, rows.astype(np.float32)), axis=1)[:, 1 : k + 1]
    ranks = np.argsort(np.argsort(square_distances(queries, centres), axis=1), axis=1)
    place = np.take_along_axis(ranks, own[near], axis=1).ravel()
    probes = int(np.quantile(place, recall)) + 1 if len(place) else len(centres)
    return Index(centres, books, parts, min(len(centres), probes))


def search(table: DataFrame, every: int = 100, k: int = 10, rerank: int = 100, recall: float = 0.96, sample_rows: int = 20_000, most_in_block: int = 65_536, most_queries: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found, by Euclidean distance, of every query.

    Queries are the rows whose vec_id is divisible by ``every``; all other rows than the query's own are candidates.
    Every row is in the index. A query visits its nearest cells, ranks their rows by asymmetric distance tables, and the
    best ``rerank`` of all cells are ranked again by the exact distance in double precision, ties to the smaller vec_id.

    Only codes and ids move to the cells. Cells with more than ``most_in_block`` rows or ``most_queries`` queries are cut
    into blocks of both, each pair of blocks a task's work, so a hot cell neither fills a task nor loses a row.

    Vectors that ``valid_vectors`` leaves out take no part. Equal rows of one id count once; different vectors under one
    id are each a candidate of other queries, and the nearest of them is reported; of an id's different vectors the least
    by its bytes is the query. Fewer candidates than k give fewer ranks; an empty table gives no rows.
    """
    vectors = materialise(valid_vectors(table).distinct(), "vectors")
    n = vectors.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n == 0:
        return empty
    index = fit(sample(vectors, sample_rows, n), n, recall, k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = index.encode(stack(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes])], ["cell", "id", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                v = stack(batch.column(1).slice(at, 1024)).astype(np.float32)
                cells = np.argsort(square_distances(v, index.centres), axis=1)[:, : index.probes]
                rows = pa.array(np.repeat(np.arange(len(v)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).slice(at, 1024).take(rows), batch.column(1).slice(at, 1024).take(rows)], ["cell", "id", "code"])

    ddl = "cell int, id long, code binary"
    coded = materialise(vectors.mapInArrow(encode, ddl), "codes")
    queries = materialise(vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    asked = queries.mapInArrow(probe, ddl)
    by_cell = lambda df, most: {r[0]: -(-r[1] // most) for r in df.groupBy("cell").count().collect()}  # noqa: E731  at most a row per cell
    row_blocks, query_blocks = by_cell(coded, most_in_block), by_cell(asked.select("cell"), most_queries)

    def spread(own: dict[int, int], other: dict[int, int], kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                mine = ids // every % np.array([own.get(c, 1) for c in cell.tolist()], np.int64) if len(ids) else ids
                copies = np.array([other.get(c, 0) for c in cell.tolist()], np.int64)
                row = np.repeat(np.arange(len(ids)), copies)
                theirs = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                blocks = (theirs, mine[row]) if kind else (mine[row], theirs)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell[row]), pa.array(blocks[0].astype(np.int32)), pa.array(blocks[1].astype(np.int32)), pa.array(np.full(len(row), kind, np.int32)), batch.column(1).take(take), batch.column(2).take(take)], ["cell", "query_block", "row_block", "kind", "id", "code"])

        return run

    wide = "cell int, query_block int, row_block int, kind int, id long, code binary"
    both = asked.mapInArrow(spread(query_blocks, row_blocks, 0), wide).unionByName(coded.mapInArrow(spread(row_blocks, query_blocks, 1), wide))
    key = ["cell", "query_block", "row_block"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, tables, best = None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                d, v = best
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(v[ok]), pa.array(d[ok].astype(np.float64))], ["query_id", "vec_id", "about"])

        for cell, kind, part in _runs(batches):
            if kind == 0:
                if cell != now:
                    yield from out()
                    ids, vectors_, best = part.column("id").to_numpy(), stack(part.column("code")), None
                else:
                    ids, vectors_ = np.concatenate([ids, part.column("id").to_numpy()]), np.concatenate([vectors_, stack(part.column("code"))])
                now, tables = cell, None
                continue
            if cell != now:
                continue  # no query visits this block
            if tables is None:
                tables = index.tables(vectors_.astype(np.float32) - index.centres[cell[0]])
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            rows = part.column("id").to_numpy()
            for at in range(0, len(rows), 4096):
                c, r = codes[at : at + 4096], rows[at : at + 4096]
                d = np.zeros((len(ids), len(r)), np.float32)
                for m in range(c.shape[1]):
                    d += tables[:, m, c[:, m]]
                d[ids[:, None] == r[None]] = np.inf
                v = np.broadcast_to(r, d.shape)
                if best is not None:
                    d, v = np.concatenate([best[0], d], 1), np.concatenate([best[1], v], 1)
                order = np.argsort(d, axis=1, kind="stable")[:, :rerank]  # rows come by id, so equal ones stay in that order
                best = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)
        yield from out()

    found = both.repartition(*key).sortWithinPartitions(*key, "kind", "id").mapInArrow(rank, "query_id long, vec_id long, about double")
    first = Window.partitionBy("query_id").orderBy("about", "vec_id")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rerank)
    theirs = vectors.select(F.col("id").alias("vec_id"), "vector")
    mine = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    pairs = found.select("query_id", "vec_id").distinct().join(theirs, "vec_id").join(mine, "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.sqrt(((stack(batch.column(2)) - stack(batch.column(3))) ** 2).sum(1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "vector", "query").mapInArrow(exact, "query_id long, vec_id long, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(cell and blocks, kind, rows), a piece of a batch at a time, from rows in that order."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = keys[a].tolist()
                yield tuple(key[:3]), key[3], batch.slice(a, b - a)
