"""The relation of points, and views of the test tables in its shape.

A point is one row: which blob (batch) it belongs to, the blob's start, the
metric, its position in the metric's column in that blob, timestamp in
microseconds, value and tag. A set of blobs is the DataFrame itself; the order
of a metric's points in a set is (blob_start, blob_ord, pos), never the order
of rows. Tags are '' where there are none; values are never null.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.ids import metric_id

_COMMON = [
    T.StructField("kind", T.StringType(), False),
    T.StructField("blob_id", T.LongType(), False),
    T.StructField("blob_start", T.LongType(), False),
    T.StructField("blob_ord", T.IntegerType(), False),
    T.StructField("metric_id", T.LongType(), False),
    T.StructField("metric_name", T.StringType(), True),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("ts", T.LongType(), False),
]
NUMERIC = T.StructType([*_COMMON, T.StructField("val", T.DoubleType(), False), T.StructField("tag", T.StringType(), False)])
TEXT = T.StructType([*_COMMON, T.StructField("val", T.StringType(), False), T.StructField("tag", T.StringType(), False)])
COLUMNS = [f.name for f in NUMERIC]
#: The order of a metric's points in a set of blobs.
ORDER = ["blob_start", "blob_ord", "pos"]
#: Microseconds of a day.
DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def points(df: DataFrame, kind: str, name: Column, ts: Column, val: Column, tag: Column | None = None, blob_us: int = DAY, order: list[Column] | None = None, ident: Column | None = None, slot_us: int | None = None) -> DataFrame:
    """Rows as points, one blob for each `blob_us` of time.

    order: what orders a metric's points in a blob after their time; it should
    leave no ties. The window is by (metric, blob), so a metric with most of
    the rows is still dealt out by blob.

    slot_us: where a metric's blob may be too large to sort in one task, its
    points are counted inside slots of so much time; a slot's first position is
    the number of points in the slots before it.
    """
    extra = {f"__o{i}": c for i, c in enumerate(order or [])}
    rows = df.select(
        name.cast("string").alias("metric_name"),
        ts.alias("ts"),
        val.cast("double" if kind == "numeric" else "string").alias("val"),
        (F.coalesce(tag.cast("string"), F.lit("")) if tag is not None else F.lit("")).alias("tag"),
        *[c.alias(n) for n, c in extra.items()],
        *([ident.cast("long").alias("metric_id")] if ident is not None else []),
    ).where("ts is not null and val is not null")
    if ident is None:
        rows = rows.withColumn("metric_id", metric_id(F.col("metric_name")))
    rows = rows.withColumn("blob_start", F.col("ts") - F.pmod(F.col("ts"), F.lit(blob_us)))
    if slot_us is None:
        pos = F.row_number().over(Window.partitionBy("metric_id", "blob_start").orderBy("ts", *extra)) - 1
    else:
        key = ["metric_id", "blob_start", "__slot"]
        rows = rows.withColumn("__slot", F.expr(f"(ts - blob_start) div {slot_us}"))
        before = Window.partitionBy("metric_id", "blob_start").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        firsts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        rows = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*key).orderBy("ts", *extra))).join(firsts.drop("__n"), key)
        pos = (F.col("__first") + F.col("__own") - 1).cast("int")
    return rows.select(
        F.lit(kind).alias("kind"),
        F.expr(f"blob_start div {blob_us}").alias("blob_id"),
        "blob_start",
        F.lit(0).alias("blob_ord"),
        "metric_id",
        "metric_name",
        pos.alias("pos"),
        "ts",
        "val",
        "tag",
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within(df: DataFrame, column: str, blob_id: int, blob_us: int = DAY) -> DataFrame:
    """The rows of one blob by plain comparisons of the time column, which reach its Parquet scan."""
    epoch, kind = datetime(1970, 1, 1), df.schema[column].dataType
    first, after = (F.lit((epoch + timedelta(microseconds=blob_us * b)).isoformat(" ")).cast(kind) for b in (blob_id, blob_id + 1))
    return df.where((F.col(column) >= first) & (F.col(column) < after))


def event_points(spark: SparkSession, sf_dir: str, blob_us: int = DAY, metric: str | None = None, blob_id: int | None = None) -> DataFrame:
    """Numeric points of the events table: a metric per event type, a blob per day.

    metric, blob_id: only their points. These filters come before positions are
    counted, which they do not change, as positions count inside a metric and blob.
    """
    e = table(spark, sf_dir, "events")
    if metric is not None:
        e = e.where(F.col("event_type") == metric)
    if blob_id is not None:
        e = within(e, "ts", blob_id, blob_us)
    return points(e, "numeric", F.col("event_type"), micros(F.col("ts")), F.col("value"), F.col("props"), blob_us, [F.col("event_id")])


def user_points(spark: SparkSession, sf_dir: str, blob_us: int = DAY) -> DataFrame:
    """Text points of the events table: a metric per user, the event type as value."""
    e = table(spark, sf_dir, "events")
    return points(e, "text", F.col("user_id"), micros(F.col("ts")), F.col("event_type"), None, blob_us, [F.col("event_id")])


def ship_points(spark: SparkSession, sf_dir: str, blob_us: int = 365 * DAY) -> DataFrame:
    """Numeric points of the lineitem table: a metric per return flag, many points at one time, counted day by day."""
    li = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus")]
    return points(li, "numeric", F.col("l_returnflag"), micros(F.col("l_shipdate")), F.col("l_extendedprice"), F.col("l_linestatus"), blob_us, order, slot_us=DAY)
