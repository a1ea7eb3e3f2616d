"""How good clusters are, and what they look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Of two arrays of ids: no predictions give precision 0, no truth gives recall 1."""
    both = F.size(F.array_intersect(predicted, truth))
    precision = F.when(F.size(predicted) == 0, 0.0).otherwise(both / F.size(predicted))
    recall = F.when(F.size(truth) == 0, 1.0).otherwise(both / F.size(truth))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return precision, recall, f1


def outcome(predicted: Column, truth: Column) -> Column:
    """TP if all and only true ones are predicted, TN if neither has any, FP if others or too few are, FN if none is."""
    same = (F.size(F.array_except(predicted, truth)) == 0) & (F.size(F.array_except(truth, predicted)) == 0)
    return F.when((F.size(predicted) == 0) & (F.size(truth) == 0), "TN").when(same, "TP").when(F.size(predicted) == 0, "FN").otherwise("FP")


def classification(labelled: DataFrame) -> DataFrame:
    """One row from ``labelled(outcome)``: counts, accuracy, precision and recall of both classes, macro precision."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    out = labelled.agg(*(n(x).alias(x.lower()) for x in ("TP", "FP", "TN", "FN")))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    out = out.withColumn("accuracy", F.when(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == 0, 0.0).otherwise((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))))
    out = out.withColumns({"precision_dup": ratio("tp", "fp"), "recall_dup": ratio("tp", "fn"), "precision_non": ratio("tn", "fn"), "recall_non": ratio("tn", "fp")})
    return out.withColumn("macro_precision", (F.col("precision_dup") + F.col("precision_non")) / 2)


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """``(ari)`` of ``pairs(truth, predicted)``, a row per item."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("items"))
    rows = cells.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("rows"))
    columns = cells.groupBy("predicted").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("columns"))
    one = both.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(columns))  # one row each
    expected = F.col("rows") * F.col("columns") / (F.col("items") * (F.col("items") - 1) / 2)
    most = (F.col("rows") + F.col("columns")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """``(cluster, size)`` of ``labelled(id, cluster)``."""
    return labelled.groupBy("cluster").agg(F.count("*").alias("size"))


def cluster_summary(sizes: DataFrame) -> DataFrame:
    many = F.col("size") > 1
    return sizes.agg(
        F.sum("size").alias("rows"), F.count("*").alias("clusters"), F.count_if(~many).alias("singletons"), F.count_if(many).alias("duplicate_clusters"),
        F.round(1 - F.count("*") / F.sum("size"), 6).alias("dedup_rate"), F.round(F.avg("size"), 6).alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"),
    )


def size_histogram(sizes: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    kept = sizes.where((F.col("size") >= low) & (F.lit(high is None) | (F.col("size") <= F.lit(high))))
    return kept.groupBy("size").agg(F.count("*").alias("clusters"))


def size_bins(sizes: DataFrame, step: int = 5) -> DataFrame:
    """Clusters by ranges (1, 1 + step], and so on; size 1 is in none."""
    k = F.floor((F.col("size") - 2) / step)
    binned = sizes.where("size > 1").groupBy((k * step + 1).alias("above")).agg(F.count("*").alias("clusters"), F.sum("size").alias("rows"))
    return binned.withColumn("up_to", F.col("above") + step)


def size_cumulative(sizes: DataFrame) -> DataFrame:
    """``(size, clusters_up_to)`` from the histogram, which has few rows."""
    return size_histogram(sizes).select("size", F.sum("clusters").over(Window.orderBy("size")).alias("clusters_up_to"))


def top_clusters(sizes: DataFrame, n: int = 10) -> DataFrame:
    """The n largest clusters with their rank, ties to the smaller label."""
    top = sizes.orderBy(F.desc("size"), "cluster").limit(n)
    return top.select("cluster", "size", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")).alias("rank"))


def cluster_samples(labelled: DataFrame, docs: DataFrame, n: int = 3, preview: int = 500) -> DataFrame:
    """The first n rows of every cluster of two or more, with the beginning of their texts."""
    by = Window.partitionBy("cluster").orderBy("id")
    picked = labelled.withColumn("k", F.row_number().over(by)).where(F.col("k") <= n)
    many = cluster_sizes(labelled).where("size > 1").select("cluster")
    texts = docs.select(docs["doc_id"].alias("id"), F.substring("text", 1, preview).alias("preview"))
    return picked.join(many, "cluster").join(texts, "id").select("cluster", "id", "k", "preview")


def cluster_search(labelled: DataFrame, docs: DataFrame, query: str, n: int = 20) -> DataFrame:
    """The first n rows whose text has the query, without regard to case."""
    texts = docs.select(docs["doc_id"].alias("id"), "text").where(F.contains(F.lower("text"), F.lit(query.lower())))
    return texts.join(labelled, "id").orderBy("id").limit(n).select("id", "cluster")


def similarity_stats(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """From ``pairs(a, b, similarity)`` of clusters: each member's best similarity to another, summed up."""
    sides = pairs.select(F.col("a").alias("id"), "similarity").union(pairs.select("b", "similarity"))
    best = sides.groupBy("id").agg(F.max("similarity").alias("best"))
    return best.agg(F.count("*").alias("members"), F.round(F.max("best"), 6).alias("highest"), F.round(F.avg("best"), 6).alias("mean"), F.round(F.min("best"), 6).alias("lowest"), F.round(F.percentile("best", 0.9), 6).alias("p90"), F.round(F.count_if(F.col("best") < threshold) / F.count("*"), 6).alias("false_positive_rate"))
