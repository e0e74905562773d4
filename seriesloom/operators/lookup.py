"""Lookups by position and global index, existence, and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.ids import metric_id, unsigned_order
from seriesloom.operators.scan import beside, blob_offsets, of_blob, of_metric, with_global_index


def at(points: DataFrame, metric: int | str, blob_id: int, pos: int) -> DataFrame:
    """The point at a position of one blob: one row, or none if there is no such position."""
    return of_metric(of_blob(points, blob_id), metric).where(F.col("pos") == pos).select("ts", "val", "tag")


def set_at(points: DataFrame, metric: int | str, gidx: int) -> DataFrame:
    """The point at a global index, in two steps: prefix sums over the metric's blobs find the blob, a filter the point."""
    rows = of_metric(points, metric)
    home = blob_offsets(rows).where((F.col("first_gidx") <= gidx) & (F.lit(gidx) < F.col("first_gidx") + F.col("n")))
    home = home.withColumn("pos", (F.lit(gidx) - F.col("first_gidx")).cast("int")).drop("n", "first_gidx")
    return beside(rows, home, "pos").select("ts", "val", "tag")


def set_at_many(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """The points at many (metric_id, gidx) at once; wanted rows without a point give no row."""
    return with_global_index(points).join(wanted, ["metric_id", "gidx"]).select("metric_id", "metric_name", "gidx", "ts", "val", "tag")


def at_indexes(points: DataFrame, indexes: Sequence[int]) -> DataFrame:
    """The points of every metric at some global indexes; negative ones and those out of range give no row."""
    return with_global_index(points).where(F.col("gidx").isin([i for i in indexes if i >= 0])).select("metric_id", "metric_name", "gidx", "ts", "val", "tag")


def has_metric(points: DataFrame, metric: int | str) -> bool:
    return not of_metric(points, metric).limit(1).isEmpty()


def _asked(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, metric_id) of each name asked for; a null id if it does not occur."""
    asked = points.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string").withColumn("hash", metric_id(F.col("name")))
    known = points.select("metric_id", "metric_name").distinct()
    by_name = known.where("metric_name is not null").select("metric_id", F.col("metric_name").alias("name"))
    by_hash = known.where("metric_name is null").join(asked.withColumnRenamed("hash", "metric_id"), "metric_id").select("metric_id", "name")
    return asked.select("name").join(by_name.unionByName(by_hash), "name", "left")


def has_metrics(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, present) for some names."""
    return _asked(points, names).groupBy("name").agg(F.max(F.col("metric_id").isNotNull()).alias("present"))


def metric_ids(points: DataFrame, per_blob: bool = False) -> DataFrame:
    """Distinct ids, by blob if asked, with a key for their unsigned order."""
    keys = ["blob_id", "metric_id"] if per_blob else ["metric_id"]
    return points.select(*keys).distinct().withColumn("unsigned_key", unsigned_order(F.col("metric_id")))


def metric_names(points: DataFrame, per_blob: bool = False) -> DataFrame:
    """Distinct names that are known."""
    keys = ["blob_id", "metric_name"] if per_blob else ["metric_name"]
    return points.where("metric_name is not null").select(*keys).distinct()


def resolve_names(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, metric_id): ids of names that occur, by name or, in blobs without names, by their hash; a name that hashes to another's id stays apart."""
    return _asked(points, names).where("metric_id is not null").select("name", "metric_id").distinct()
