"""Connected components of an edge table, in Spark throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.shared import drop_table, materialise

FLUSH_EDGES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def star() -> pa.RecordBatch:
        nodes = [x for x in parent if parent[x] != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        seen += batch.num_rows
        if seen >= FLUSH_EDGES:
            yield star()
            parent.clear()
            seen = 0
    yield star()


def contract(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges by a star forest with the same components (at most FLUSH_EDGES held at a time)."""
    return edges.mapInArrow(_forest, "a long, b long")


def connected_components(edges: DataFrame, src: str, dst: str, contracted: bool = True) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternates large-star and small-star until the edges stop changing, which takes a number of rounds
    logarithmic in the longest path. Every round is written to the shared folder, so nothing is recomputed
    after a lost executor. Where fewer than FLUSH_EDGES edges are left, one task ends the work.
    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    both = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    both = both.where("a is not null and b is not null and a <> b")
    raw = None
    if contracted:
        raw = materialise(both, "links")  # so that no task runs a Python worker here and one that makes the edges
        both = contract(raw)
    current = materialise(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    drop_table(raw)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(current)
    if contracted and 0 < before[0] < FLUSH_EDGES:
        one = materialise(contract(current.coalesce(1)), "edges")
        drop_table(current)
        current, before = one, (0,)
    while before[0]:
        sides = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        following = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        drop_table(current)
        current, after = following, state(following)
        if after == before:
            break
        before = after
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
