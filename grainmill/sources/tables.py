"""Tables by file type, dense row numbers, saving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERNAL = ("__INDEX__", "__CLUSTER__")


def load(spark: SparkSession, path: str, file_type: str = "parquet", **options) -> DataFrame:
    if file_type not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown file type {file_type!r}")
    return spark.read.format(file_type).options(**options).load(path)


def with_index(rows: DataFrame, order: str | None = None) -> DataFrame:
    """``rows`` with ``__INDEX__`` from 0 without gaps, in order of a column or of reading.

    Rows are counted by partition first; no window holds all of them.
    """
    placed = rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows
    marked = placed.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_place", 33)
    counts = marked.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    base, starts = 0, []
    for r in counts:
        starts.append((r["part"], base))
        base += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _base long")
    joined = marked.withColumn("_part", part).join(F.broadcast(starts), "_part")
    index = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return joined.withColumn("__INDEX__", index).select(*rows.columns, "__INDEX__")


def save(rows: DataFrame, path: str, keep_index: bool = False, keep_cluster: bool = False) -> None:
    """Write Parquet without the internal columns, unless they are to be kept."""
    gone = [c for c, keep in zip(INTERNAL, (keep_index, keep_cluster)) if not keep]
    rows.drop(*gone).write.mode("overwrite").parquet(path)
