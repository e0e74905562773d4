"""Synthetic series, generated where they are needed: no data passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.ids import metric_id

START = 1_700_000_000_000_000
#: Seconds between points of each named profile.
PROFILES = {"decimal_gauge_2dp": 15, "decimal_gauge_4dp": 15, "counter": 15, "sparse_constant": 60, "regular_scrape_60s": 60, "bursty_scrape": 15, "worst_case": 1}


def _grid(spark: SparkSession, metrics: int, points: int) -> DataFrame:
    """(m, pos), a partition's metrics side by side."""
    return spark.range(metrics).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("pos"))


def _unit(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that tasks may be repeated and rows come in any order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def _finish(rows: DataFrame, name: str) -> DataFrame:
    label = F.concat(F.lit(name), (F.col("m") + 1000).cast("string"))
    return rows.select(
        F.lit("numeric").alias("kind"), F.lit(0).cast("long").alias("blob_id"), F.lit(START).alias("blob_start"), F.lit(0).alias("blob_ord"), metric_id(label).alias("metric_id"), label.alias("metric_name"), F.col("pos").cast("int").alias("pos"), "ts", "val", F.lit("").alias("tag")
    )


def random_walk(spark: SparkSession, metrics: int = 200, points: int = 200, value_jitter: float = 0.005, ts_jitter: float = 0.001, seed: int = 42, shared: bool = False) -> DataFrame:
    """Walks around 100 + 10 m, a second apart; shared: all metrics have the same timestamps."""
    rows = _grid(spark, metrics, points)
    noise = (_unit(*([] if shared else [F.col("m")]), F.col("pos"), seed=seed) * 2 - 1) * ts_jitter
    rows = rows.withColumn("ts", (F.lit(START) + F.col("pos") * 1_000_000 + F.round(noise * 1_000_000)).cast("long"))
    step = F.log(1 + (_unit(F.col("m"), F.col("pos"), seed=seed + 1) * 2 - 1) * value_jitter)
    w = Window.partitionBy("m").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _finish(rows.withColumn("val", (100 + 10 * F.col("m")) * F.exp(F.sum(step).over(w))), "metric.")


def profile(spark: SparkSession, name: str, metrics: int = 10, points: int = 1000, seed: int = 42) -> DataFrame:
    """A named shape of data: see PROFILES."""
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}; one of {', '.join(PROFILES)}")
    rows = _grid(spark, metrics, points)
    gap = F.floor(F.col("pos") / 50) * 5_000_000 if name == "bursty_scrape" else F.lit(0)
    rows = rows.withColumn("ts", (F.lit(START) + F.col("pos") * (PROFILES[name] * 1_000_000) + gap).cast("long"))
    u = _unit(F.col("m"), F.col("pos"), seed=seed)
    w = Window.partitionBy("m").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    if name == "counter":
        val = F.sum(1 + F.floor(u * 10)).over(w).cast("double")
    elif name == "sparse_constant":
        val = 50.0 + F.sum(F.when(u < 0.05, 1).otherwise(0)).over(w)
    elif name == "worst_case":
        val = u * 1000
    else:
        walk = 100 + F.sum(u - 0.5).over(w)
        val = F.round(walk, 4 if name == "decimal_gauge_4dp" else 2)
    return _finish(rows.withColumn("val", val), f"{name}.")


def text_events(spark: SparkSession, metrics: int = 20, points: int = 50, seed: int = 42) -> DataFrame:
    """Text points like `[LEVEL] metric_7 event_3 processing_complete`."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")]), (F.floor(_unit(F.col("m"), F.col("pos"), seed=seed) * 5) + 1).cast("int"))
    rows = _grid(spark, metrics, points).withColumn("ts", (F.lit(START) + F.col("pos") * 1_000_000).cast("long"))
    val = F.format_string("[%s] metric_%d event_%d processing_complete", level, F.col("m") + 1000, F.col("pos"))
    return _finish(rows.withColumn("val", val), "text.").withColumn("kind", F.lit("text"))
