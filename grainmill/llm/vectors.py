"""Reading embedding columns, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, vector)`` of the rows that can be compared; the vector as little-endian doubles.

    Left out are null ids, and vectors that are null, empty or zero, hold null or non-finite components, or have
    another length than most.
    """
    v = F.col("v")
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v"))
    fine = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    rows = rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], ["id", "vector"])

    return rows.mapInArrow(pack, "id long, vector binary")


def stack(column) -> np.ndarray:
    """A binary column of doubles as a matrix."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if values else np.zeros((0, 0))


def sample(vectors: DataFrame, most: int, n: int) -> np.ndarray:
    """At most about ``most`` of the n vectors on the driver, picked by a hash of the id, in order of that hash."""
    share = min(1.0, most / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = picked.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").collect()
    return stack([bytes(r[0]) for r in rows])
