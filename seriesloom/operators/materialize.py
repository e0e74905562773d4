"""Series as arrays: one row per metric, points in order, for access by index.

A metric's array must fit in one executor's memory. The window form
(scan.with_global_index) has no such limit and is the default elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.scan import of_metric


def materialize(points: DataFrame, metric: int | str | None = None, per_blob: bool = False) -> DataFrame:
    """(metric_id, metric_name, points, n, first_ts, last_ts), or so for each blob; points: array of (ts, val, tag).

    Mixed sets of tagged and untagged blobs have '' where there is no tag.
    """
    keys = ["blob_id", "metric_id"] if per_blob else ["metric_id"]
    one = F.struct("blob_start", "blob_ord", "blob_id", "pos", "ts", "val", F.coalesce("tag", F.lit("")).alias("tag"))
    rows = of_metric(points, metric).groupBy(*keys).agg(F.first("metric_name", ignorenulls=True).alias("metric_name"), F.array_sort(F.collect_list(one)).alias("p"))
    series = F.transform("p", lambda x: F.struct(x["ts"].alias("ts"), x["val"].alias("val"), x["tag"].alias("tag")))
    return rows.select(*keys, "metric_name", series.alias("points")).withColumns({"n": F.size("points"), "first_ts": F.get("points", F.lit(0))["ts"], "last_ts": F.get("points", F.size("points") - 1)["ts"]})


def point_at(index: Column | int, points: str = "points") -> Column:
    """The point at an index of a materialized array; null for a negative one or one out of range."""
    i = index if isinstance(index, Column) else F.lit(index)
    return F.when(i >= 0, F.get(F.col(points), i))


def value_at(index: Column | int) -> Column:
    return point_at(index)["val"]


def timestamp_at(index: Column | int) -> Column:
    return point_at(index)["ts"]


def tag_at(index: Column | int) -> Column:
    return point_at(index)["tag"]


def exploded(series: DataFrame) -> DataFrame:
    """Materialized series as rows: (metric_id, metric_name, gidx, ts, val, tag)."""
    return series.select("metric_id", "metric_name", F.posexplode("points").alias("gidx", "p")).select("metric_id", "metric_name", "gidx", "p.ts", "p.val", "p.tag")
