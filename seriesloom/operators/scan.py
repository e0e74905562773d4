"""Scans of one metric, in one blob or across a set, and the global index.

Filters on metric or blob come before any window and on its own partition
columns, so that they reach the scan of a stored relation of points;
projections prune columns there.

A metric is known by its id. Blobs keyed by id carry no names, so a name also
stands for the points without one whose id is its hash. Two names of one id are
two metrics; points without a name are then a third.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.ids import metric_id

#: What a scan may project.
PARTS = {"all": ["ts", "val", "tag"], "timestamps": ["ts"], "values": ["val"], "tags": ["tag"]}


def of_metric(points: DataFrame, metric: int | str | None = None) -> DataFrame:
    """Points of a metric by id (int) or name (str); of all metrics for none."""
    if metric is None:
        return points
    if isinstance(metric, str):
        return points.where(is_named(metric))
    return points.where(F.col("metric_id") == F.lit(metric - (1 << 64) if metric >= 1 << 63 else metric))


def is_named(name: str) -> Column:
    """Whether a point is of the metric of this name: by name, or by the name's hash where there is none."""
    return (F.col("metric_name") == name) | (F.col("metric_name").isNull() & (F.col("metric_id") == metric_id(F.lit(name))))


def with_sole_name(rows: DataFrame) -> DataFrame:
    """rows with the name of a metric also where it is null, if its id has one name only. For aggregates: a window by metric_id."""
    w = Window.partitionBy("metric_id")
    sole = F.when(F.min("metric_name").over(w) == F.max("metric_name").over(w), F.min("metric_name").over(w))
    return rows.withColumn("metric_name", F.coalesce("metric_name", sole))


def of_blob(points: DataFrame, blob_id: int) -> DataFrame:
    return points.where(F.col("blob_id") == blob_id)


def scan(points: DataFrame, metric: int | str, blob_id: int, part: str = "all") -> DataFrame:
    """(pos, part) of one metric in one blob; nothing for a missing metric."""
    return of_metric(of_blob(points, blob_id), metric).select("pos", *PARTS[part])


def blob_index(points: DataFrame) -> DataFrame:
    """The index: points of each metric in each blob, with first and last timestamp."""
    key = ["blob_id", "blob_start", "blob_ord", "metric_id", "metric_name"]
    return with_sole_name(points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("ts", "pos").alias("first_ts"), F.max_by("ts", "pos").alias("last_ts")))


def blob_offsets(points: DataFrame) -> DataFrame:
    """(blob_id, blob_start, blob_ord, metric_id, own_name, metric_name, n, first_gidx): where each blob begins in a metric's global index.

    own_name: the name in that blob, which may be null; metric_name: the
    metric's. Prefix sums over blobs, not over points: a metric with most of
    the points costs one task as many rows as it has blobs.
    """
    n = points.groupBy("blob_id", "blob_start", "blob_ord", "metric_id", "metric_name").agg(F.count(F.lit(1)).alias("n"))
    n = with_sole_name(n.withColumn("own_name", F.col("metric_name")))
    w = Window.partitionBy("metric_id", "metric_name").orderBy("blob_start", "blob_ord", "blob_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first_gidx", F.coalesce(F.sum("n").over(w), F.lit(0)))


def beside(points: DataFrame, offsets: DataFrame, *more: str) -> DataFrame:
    """points joined to rows of blob_offsets, with the metric's name from these. more: other columns that must agree."""
    keys = ["blob_id", "blob_start", "blob_ord", "metric_id", *more]
    other = offsets.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("own_name").alias("__own"), F.col("metric_name").alias("__name"), *[c for c in offsets.columns if c not in (*keys, "own_name", "metric_name")])
    on = F.col("metric_name").eqNullSafe(F.col("__own"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return points.join(other, on).drop("__own", *[f"__{k}" for k in keys]).withColumn("metric_name", F.col("__name")).drop("__name")


def with_global_index(points: DataFrame) -> DataFrame:
    """points with gidx: 0 .. n - 1 along (blob_start, blob_ord, pos) of each metric."""
    at = blob_offsets(points).drop("n")
    return beside(points, at).withColumn("gidx", F.col("first_gidx") + F.col("pos")).drop("first_gidx")


def set_scan(points: DataFrame, metric: int | str | None = None, part: str = "all", limit: int | None = None) -> DataFrame:
    """(metric_id, metric_name, gidx, part) of a metric, or of all, across the set. limit: only the first so many of each metric."""
    rows = with_global_index(of_metric(points, metric))
    if limit is not None:
        rows = rows.where(F.col("gidx") < limit)
    return rows.select("metric_id", "metric_name", "gidx", *PARTS[part])


def first_points(points: DataFrame, limit: int, metric: int | str | None = None) -> DataFrame:
    """The first points of each metric by one window: cheaper than set_scan when every metric's blobs are few.

    The rank itself is compared, so that tasks keep only that many rows a metric before the shuffle.
    """
    w = Window.partitionBy("metric_id", "metric_name").orderBy("blob_start", "blob_ord", "pos")
    rows = of_metric(points, metric)
    sole = rows.groupBy("metric_id").agg(F.min("metric_name").alias("__least"), F.max("metric_name").alias("__most")).where(F.col("__least") == F.col("__most"))
    rows = rows.join(sole.drop("__most"), "metric_id", "left").withColumn("metric_name", F.coalesce("metric_name", "__least")).drop("__least").select(*points.columns)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).withColumn("gidx", F.col("rn") - 1).drop("rn")


def iterate(points: DataFrame, metric: int | str, part: str = "all") -> Iterator[tuple]:
    """(gidx, part...) to the driver in order, a partition at a time."""
    for r in set_scan(points, metric, part).orderBy("gidx").toLocalIterator():
        yield tuple(r)[2:]


def for_each(points: DataFrame, metric: int | str, visit: Callable[..., bool], part: str = "all") -> bool:
    """Call visit(gidx, part...) in order until it returns false; false if the metric is missing or visit is none."""
    if visit is None:
        return False
    seen = False
    for row in iterate(points, metric, part):
        seen = True
        if not visit(*row):
            break
    return seen


def tag_or_empty(tag: Column) -> Column:
    return F.coalesce(tag, F.lit(""))
