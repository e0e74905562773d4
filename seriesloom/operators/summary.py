"""Per-metric summaries. All are grouped aggregates, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from seriesloom.operators.scan import with_sole_name


def _order() -> Column:
    return F.struct("blob_start", "blob_ord", "blob_id", "pos")


def blob_lengths(points: DataFrame) -> DataFrame:
    """Points of each metric in each blob."""
    return with_sole_name(points.groupBy("blob_id", "metric_id", "metric_name").agg(F.count(F.lit(1)).alias("n")))


def _by_metric(parts: DataFrame) -> GroupedData:
    """Aggregates by (metric_id, metric_name), grouped once more with the names of metrics that some blobs know by id only."""
    return with_sole_name(parts).groupBy("metric_id", "metric_name")


def lengths(points: DataFrame) -> DataFrame:
    """Points of each metric in the set."""
    return _by_metric(points.groupBy("metric_id", "metric_name").agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("n"))


def metric_count(points: DataFrame, per_blob: bool = False) -> DataFrame:
    """Distinct metrics, in each blob or in the set."""
    keys = ["blob_id"] if per_blob else []
    return points.groupBy(*keys).agg(F.count_distinct("metric_id").alias("n_metrics"))


def durations(points: DataFrame) -> DataFrame:
    """Last timestamp minus first, by position and not by value, at least 0."""
    at = F.struct(_order().alias("at"), "ts")
    ends = _by_metric(points.groupBy("metric_id", "metric_name").agg(F.min(at).alias("first"), F.max(at).alias("last"))).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return ends.select("metric_id", "metric_name", F.greatest(F.lit(0), F.col("last.ts") - F.col("first.ts")).alias("duration_us"))


def time_range(points: DataFrame) -> DataFrame:
    """Starts of the first and the last blob (not the last point)."""
    return points.agg(F.min("blob_start").alias("start_us"), F.max("blob_start").alias("end_us"))


def statistics(df: DataFrame, value: str = "val", keys: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean, median (mean of the middle two) and population deviation; 0 for no rows."""
    zero = F.lit(0.0)
    return df.groupBy(*(keys or [])).agg(
        F.coalesce(F.min(value), zero).alias("min"),
        F.coalesce(F.max(value), zero).alias("max"),
        F.coalesce(F.avg(value), zero).alias("mean"),
        F.coalesce(F.percentile(value, F.lit(0.5)), zero).alias("median"),
        F.coalesce(F.stddev_pop(value), zero).alias("stddev"),
    )


def value_sums(points: DataFrame) -> DataFrame:
    return _by_metric(points.groupBy("metric_id", "metric_name").agg(F.sum("val").alias("total"))).agg(F.sum("total").alias("total"))


def blobs(points: DataFrame) -> DataFrame:
    """The dimension of blobs: one row each, in the order of the set by blob_start, blob_ord."""
    return points.groupBy("kind", "blob_id", "blob_start", "blob_ord").agg(
        F.count_distinct("metric_id").alias("n_metrics"), F.count(F.lit(1)).alias("n_points"), F.max(F.col("tag") != "").alias("has_tag"), F.max(F.col("metric_name").isNotNull()).alias("has_names")
    )


def blob_at(points: DataFrame, n: int) -> DataFrame:
    """Points of the n-th blob in order of start; none for a negative or too large n."""
    rank = F.row_number().over(_blob_window())
    one = points.select("blob_id", "blob_start", "blob_ord").distinct().withColumn("rank", rank).where(F.col("rank") == n + 1).drop("rank")
    return points.join(F.broadcast(one), ["blob_id", "blob_start", "blob_ord"], "left_semi")  # at most one row


def _blob_window():
    from pyspark.sql import Window

    return Window.orderBy("blob_start", "blob_ord", "blob_id")  # one row a blob
