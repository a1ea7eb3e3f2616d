"""Exact deduplication of a stream of documents against all that was delivered before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text as T
from grainmill.plans.shared import shared_dir


def document_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name`` (a Parquet file, or a folder of them) as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    alone = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(f"{folder}/{name}")


def deliver(stream: DataFrame, delivered: str, checkpoint: str) -> None:
    """Append to ``delivered`` the first row (smallest id) of every text, normalised, that isn't there yet.

    Each micro-batch writes its own folder, overwritten if the batch runs again, and reads all other batches' digests:
    so a batch that is repeated after a failure gives the same rows once.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        digests = rows.select(rows["doc_id"].cast("long").alias("id"), T.content_hash(T.normalize(F.coalesce(rows["text"], F.lit("")))).alias("digest"))
        first = digests.groupBy("digest").agg(F.min("id").alias("id"))
        if number:
            first = first.join(spark.read.schema("digest string, id long, batch int").parquet(delivered).where(F.col("batch") < number).select("digest"), "digest", "left_anti")
        first.write.mode("overwrite").parquet(f"{delivered}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def delivered_once(spark: SparkSession, folder: str, name: str = "documents.parquet") -> DataFrame:
    """``(id, digest)`` of what a run of ``deliver`` over that table delivers."""
    import uuid

    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    deliver(document_stream(spark, folder, name), f"{place}/delivered", f"{place}/state")
    return spark.read.schema("digest string, id long, batch int").parquet(f"{place}/delivered").select("id", "digest")


def within_watermark(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose key did not come within the watermark's delay; state is bounded by the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(start, event_type, n)`` per window, for streams (late rows beyond the delay are left out) and tables."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
