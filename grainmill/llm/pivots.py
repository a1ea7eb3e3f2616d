"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.vectors import sample, stack, valid_vectors
from grainmill.plans.components import connected_components
from grainmill.plans.shared import materialise

BLOCK = 512


def pivot_count(n: int) -> int:
    """About the root of n in steps of 64, from 64 to 1,024."""
    return int(min(1024, max(64, 64 * round(n**0.5 / 64))))


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (equal ones by number)."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :most]


def _masks(order: np.ndarray, pivots: int) -> np.ndarray:
    bits = np.zeros((len(order), pivots), np.uint8)
    bits[np.arange(len(order))[:, None], order] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _compare(own: np.ndarray, ids: np.ndarray, unit: np.ndarray, order: np.ndarray, pivot: int, pivots: int, shared: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a list (or of two blocks of one): own is 0 for the first block, 1 for the second."""
    masks = _masks(order, pivots)
    lower = _masks(np.where(order < pivot, order, order[:, :1] * 0 + pivot), pivots) & ~_masks(np.full((1, 1), pivot), pivots)
    left = np.flatnonzero(own == 0)
    right = np.flatnonzero(own == 1) if (own == 1).any() else left
    same = right is left
    for i in range(0, len(left), BLOCK):
        x = left[i : i + BLOCK]
        for j in range(i if same else 0, len(right), BLOCK):
            y = right[j : j + BLOCK]
            count = np.zeros((len(x), len(y)), np.int16)
            first = np.ones((len(x), len(y)), bool)
            for w in range(masks.shape[1]):
                count += np.bitwise_count(masks[x, w][:, None] & masks[y, w][None])
                first &= (lower[x, w][:, None] & lower[y, w][None]) == 0  # no smaller pivot is shared: the pair is met once
            ok = (count >= shared) & first
            if same:
                ok &= ids[x][:, None] < ids[y][None]
            ok &= unit[x] @ unit[y].T >= threshold
            a, b = np.nonzero(ok)
            if len(a):
                yield ids[x[a]], ids[y[b]]


def vector_links(vectors: DataFrame, n: int, threshold: float = 0.95, nearest: int = 8, shared: int = 2, sample_rows: int = 20_000, most_in_list: int = 8192) -> DataFrame:
    """``(a, b)``, a <> b once per pair: found pairs of ``vectors(id, vector)``, all different, at cosine >= threshold.

    Pivots are vectors of a bounded sample. Each vector is described by its ``nearest`` pivots in order of nearness and
    stands in those pivots' inverted lists; pairs of a list that share at least ``shared`` pivots are verified in double
    precision, in the list of the smallest pivot they share. A list of more than ``most_in_list`` vectors is cut into
    blocks, each pair of blocks a task of its own, so nothing is cut off and no task holds more than two blocks.
    """
    pivots = sample(vectors, sample_rows, n)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = np.unique(pivots, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[: pivot_count(n)]]
    padded = -(-len(pivots) // 64) * 64
    kept = min(nearest, len(pivots))
    need = min(shared, kept)

    def lists(sizes: dict[int, int] | None):
        cuts = np.array([(sizes or {}).get(p, 1) for p in range(len(pivots))], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    v = stack(batch.column(1))
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    order = nearest_pivots(unit, pivots, kept).astype("<i2")
                    ids = batch.column(0).to_numpy()
                    if sizes is None:
                        yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32))], ["pivot"])
                        continue
                    pivot, k = order.ravel().astype(np.int64), np.repeat(np.arange(len(ids)), order.shape[1])
                    cut = cuts[pivot]
                    own = ids[k] % cut
                    copy = np.repeat(np.arange(len(k)), cut)
                    j = np.arange(len(copy)) - np.repeat(np.cumsum(cut) - cut, cut)
                    pivot, k, own = pivot[copy], k[copy], own[copy]
                    i, j, side = np.minimum(own, j), np.maximum(own, j), (own > j).astype(np.int32)
                    take = pa.array(k)
                    yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(side.astype(np.int32)), batch.column(0).take(take), pa.array([x.tobytes() for x in unit]).take(take), pa.array([x.tobytes() for x in order]).take(take)], ["pivot", "i", "j", "side", "id", "unit", "near"])

        return run

    counts = vectors.mapInArrow(lists(None), "pivot int").groupBy("pivot").count()
    sizes = {r[0]: -(-r[1] // most_in_list) for r in counts.collect()}  # at most a row per pivot
    postings = vectors.mapInArrow(lists(sizes), "pivot int, i int, j int, side int, id long, unit binary, near binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            order = np.frombuffer(b"".join(table.column("near").to_pylist()), "<i2").reshape(table.num_rows, -1).astype(np.int64)
            found = _compare(table.column("side").to_numpy(), table.column("id").to_numpy(), stack(table.column("unit")), order, table.column("pivot")[0].as_py(), padded, need, threshold)
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = postings.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return ordered.mapInArrow(verify, "a long, b long")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (pivot, i, j) after another, from rows in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(key[a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``table(vec_id, embedding)``.

    n_links counts the other rows linked directly, component_id is the smallest id that links reach. Equal vectors link
    and are compared once: classes of equal vectors are linked by ``vector_links`` and counted by their sizes. Vectors
    that ``valid_vectors`` leaves out link with nothing and stand for themselves (a null id has a null component and
    kept is true). Rows that repeat an id and a vector are two equal vectors of one id: each counts as a link of the
    other. An empty table gives no rows.
    """
    vectors = valid_vectors(table, id_col, vector_col)
    members = materialise(vectors.select("id", F.sha2("vector", 256).alias("content"), "vector"), "vectors")
    classes = materialise(members.groupBy("content").agg(F.min("id").alias("class"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    n = classes.count()
    reps = classes.select(F.col("class").alias("id"), "vector")
    links = materialise(vector_links(reps, n, threshold), "links")
    sides = links.select("a", "b").union(links.select("b", "a"))
    sizes = classes.select("class", "copies")
    degree = sides.join(sizes, sides["b"] == sizes["class"]).groupBy("a").agg(F.sum("copies").alias("others"))
    found = connected_components(links, "a", "b")
    labels = classes.join(degree, classes["class"] == degree["a"], "left").join(found, classes["class"] == found["node"], "left")
    labels = labels.select("content", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    known = members.join(labels, "content").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = table.select(table[id_col].alias("vec_id"))
    out = rows.join(known, rows["vec_id"] == known["id"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("component_id"), F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
