"""Validation of points before they become blobs: reports of what breaks a rule, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.errors import CODES, SeriesError
from seriesloom.functions.ids import metric_id
from seriesloom.operators.scan import with_global_index

#: Metrics of a blob; bytes of a text value or tag; points that a compact index can count.
MAX_METRICS, MAX_TEXT, MAX_COUNT = 65_536, 255, 65_535


def from_columns(df: DataFrame, ts: str = "timestamps", val: str = "values", tags: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Aligned arrays as rows (keep..., pos, ts, val, tag); arrays of different lengths are an error, empty ones give no rows."""
    n = F.size(ts)
    same = (n == F.size(val)) if tags is None else (n == F.size(val)) & ((F.size(tags) == n) | (F.size(tags) == 0))
    checked = F.when(same, F.col(ts)).otherwise(F.raise_error(F.lit(f"DataPointCountMismatch: {CODES['DataPointCountMismatch']}")).cast("array<bigint>"))
    tag = F.coalesce(F.get(F.col(tags), F.col("pos")), F.lit("")) if tags else F.lit("")
    rows = df.select(*(keep or []), val, *([tags] if tags else []), F.posexplode(checked).alias("pos", "ts"))
    return rows.select(*(keep or []), "pos", "ts", F.get(F.col(val), F.col("pos")).alias("val"), tag.alias("tag"))


def from_rows(df: DataFrame, ts: Column, val: Column, tag: Column | None = None, **keys: Column) -> DataFrame:
    """Arbitrary rows as points, by expressions for each part."""
    return df.select(*[c.alias(k) for k, c in keys.items()], ts.cast("long").alias("ts"), val.alias("val"), (F.coalesce(tag, F.lit("")) if tag is not None else F.lit("")).alias("tag"))


def claim_violations(points: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, claimed, code) of metrics whose number of points is not what `claims` (keys, claimed) says.

    A metric without a claim was never started; one that claims no points or too many is invalid itself.
    """
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = n.join(claims, keys, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    code = (
        F.when(F.col("claimed").isNull(), "NoMetricStarted")
        .when(F.col("claimed") <= 0, "InvalidNumOfDataPoints")
        .when(F.col("n") == 0, "NoDataPointsAdded")
        .when(F.col("n") > F.col("claimed"), "TooManyDataPoints")
        .when(F.col("n") < F.col("claimed"), "DataPointCountMismatch")
    )
    return both.select(*keys, "n", "claimed", code.alias("code")).where("code is not null")


def identity_violations(metrics: DataFrame) -> DataFrame:
    """(blob_id, metric_id, metric_name, code) of a relation with a row for each metric started in a blob.

    Zero ids, empty or repeated names, repeated ids, and blobs that mix ids and names.
    """
    w = Window.partitionBy("blob_id", "metric_id")
    named = Window.partitionBy("blob_id", "metric_name")
    blob = Window.partitionBy("blob_id")
    mode = F.col("metric_name").isNotNull()
    both = F.max(mode).over(blob) != F.min(mode).over(blob)
    code = (
        F.when(mode & (F.col("metric_name") == ""), "InvalidMetricName")
        .when(mode & (F.count(F.lit(1)).over(named) > 1), "InvalidMetricName")
        .when(~mode & (F.col("metric_id") == 0), "InvalidMetricID")
        .when(both, "MixedIdentifierMode")
        .when(~mode & (F.count(F.lit(1)).over(w) > 1), "HashCollision")
        .when(F.count(F.lit(1)).over(blob) > MAX_METRICS, "MetricCountExceeded")
    )
    return metrics.select("blob_id", "metric_id", "metric_name", code.alias("code")).where("code is not null")


def collisions(points: DataFrame) -> DataFrame:
    """(blob_id, metric_id, names): different names with one id in a blob; such a blob stores its names."""
    g = points.where("metric_name is not null").select("blob_id", "metric_id", "metric_name").distinct()
    return g.groupBy("blob_id", "metric_id").agg(F.array_sort(F.collect_list("metric_name")).alias("names")).where(F.size("names") > 1)


def hash_mismatches(points: DataFrame) -> DataFrame:
    """(metric_id, metric_name) of names that do not hash to their id."""
    named = points.where("metric_name is not null").select("metric_id", "metric_name").distinct()
    return named.where(metric_id(F.col("metric_name")) != F.col("metric_id"))


def monotonic_violations(points: DataFrame) -> DataFrame:
    """(metric_id, metric_name, n_bad): points that are not later than the one before in the metric.

    Inside a blob by a window on (metric, blob); between blobs from each blob's first and last timestamp.
    """
    inside = Window.partitionBy("metric_id", "blob_id").orderBy("pos")
    rows = points.withColumn("bad", F.col("ts") <= F.lag("ts").over(inside))
    per = rows.groupBy("metric_id", "metric_name", "blob_start", "blob_ord", "blob_id").agg(F.count(F.when(F.col("bad"), 1)).alias("n"), F.min_by("ts", "pos").alias("a"), F.max_by("ts", "pos").alias("b"))
    across = Window.partitionBy("metric_id").orderBy("blob_start", "blob_ord", "blob_id")
    per = per.withColumn("n", F.col("n") + F.when(F.col("a") <= F.lag("b").over(across), 1).otherwise(0))
    return per.groupBy("metric_id", "metric_name").agg(F.sum("n").alias("n_bad"))


def text_limit_violations(points: DataFrame) -> DataFrame:
    """Text points with a value or tag of over 255 bytes, with their code."""
    long = (F.octet_length("val") > MAX_TEXT) | (F.octet_length("tag") > MAX_TEXT)
    return points.where(long).withColumn("code", F.lit("ValueTooLong"))


def require_none(violations: DataFrame) -> None:
    """Raise the error of the first violation, if there is any."""
    row = violations.limit(1).collect()
    if row:
        raise SeriesError(row[0]["code"], ", ".join(f"{k}={v}" for k, v in row[0].asDict().items() if k != "code"))


def gaps(points: DataFrame) -> DataFrame:
    """Points whose position is not the next in their blob's column; a sound relation has none."""
    rows = with_global_index(points)
    w = Window.partitionBy("metric_id", "blob_id", "blob_start", "blob_ord").orderBy("pos")
    return rows.withColumn("want", F.row_number().over(w) - 1).where(F.col("pos") != F.col("want"))
