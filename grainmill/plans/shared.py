"""Tables that several executors need and that outlive any one of them."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); on one machine a temporary one if none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="grainmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost executor costs nothing.

    ``drop_table`` removes the files once nothing reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._grainmill_path = path
    return out


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is read, over all cores: one with fewer splits than cores is small and is dealt out once."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def drop_table(df: DataFrame | None) -> None:
    """Delete the files behind a table that ``materialise`` returned."""
    path = getattr(df, "_grainmill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def marked(hashes: DataFrame, n: int, most_bits: int = 1 << 28) -> tuple[np.ndarray, int]:
    """A bitmap in which the hashes (longs) of a one-column table are marked, and its number of bits.

    About 16 bits for each of the n hashes, up to ``most_bits`` (32 MB), so a broadcast of it is bounded. It lets some
    others through, more of them the more there are; whoever uses it must undo that by a join.
    """
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (16 * n).bit_length()))
    at = F.pmod(hashes[hashes.columns[0]], F.lit(bits))
    rows = hashes.select((at / 32768).cast("long").alias("bucket"), (at % 32768).alias("bit"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("octets")).collect():  # most_bits / 8 bytes at most
        bitmap[r["bucket"] * 4096 : r["bucket"] * 4096 + len(r["octets"])] = np.frombuffer(bytes(r["octets"]), np.uint8)
    return bitmap, bits


def is_marked(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of those hashes are marked, and a few that aren't."""
    at = hashes & (bits - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
