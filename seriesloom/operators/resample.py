"""Resampling and cutting series into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.scan import with_global_index
from seriesloom.operators.summary import lengths

#: Chunk numbers that are listed at once.
AT_ONCE = 1 << 12
#: Chunk lengths that are tried.
LADDER = [1, 2, 5, 10, 20, 50, 100, 150, 200, 500, 1000, 2000, 5000]


def ladder(cap: int, top: int = LADDER[-1]) -> list[int]:
    """Chunk lengths up to a cap, and the cap itself if it is over 1.2 times the last."""
    if cap <= 0:
        return []
    out = [p for p in LADDER if p <= min(cap, top)]
    if cap > 1.2 * out[-1]:
        out.append(cap)
    return out


def cap(points: DataFrame) -> DataFrame:
    """One row, cap: the smaller of the whole mean and the nearest-rank 90th percentile of the metrics' lengths."""
    n = lengths(points).where("n > 0")
    mean, p90 = F.floor(F.avg("n")), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long")
    return n.agg(F.when(mean > 0, F.least(mean, p90)).otherwise(F.greatest(p90, F.lit(1))).alias("cap"))


def chunks(points: DataFrame, ppms: list[int]) -> DataFrame:
    """points with (ppm, chunk, chunk_pos): every point once for each chunk length; the lengths are few."""
    rows = with_global_index(points)
    rows = rows.select("*", F.explode(F.array(*[F.lit(p) for p in ppms])).alias("ppm"))
    return rows.withColumns({"chunk": F.floor(F.col("gidx") / F.col("ppm")), "chunk_pos": F.col("gidx") % F.col("ppm")})


def chunk_sizes(points: DataFrame, ppms: list[int]) -> DataFrame:
    """(ppm, chunk, n_metrics, n_points): chunk k of all metrics makes one blob. Counts only, from the metrics' lengths."""
    n = lengths(points).select("metric_id", "n", F.explode(F.array(*[F.lit(p) for p in ppms])).alias("ppm")).withColumn("chunks", F.ceil(F.col("n") / F.col("ppm")))
    blocks = n.select("ppm", "n", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(chunks - 1) div {AT_ONCE}"))).alias("block"))
    last = F.least(F.col("chunks"), (F.col("block") + 1) * AT_ONCE) - 1
    pieces = blocks.select("ppm", "n", F.explode(F.sequence(F.col("block") * AT_ONCE, last)).alias("chunk"))
    size = F.least(F.col("ppm").cast("long"), F.col("n") - F.col("chunk") * F.col("ppm"))
    return pieces.groupBy("ppm", "chunk").agg(F.count(F.lit(1)).alias("n_metrics"), F.sum(size).alias("n_points"))


def first_n(points: DataFrame, n: int) -> DataFrame:
    """(metric_id, metric_name, i, ts, val): the first n points of each metric."""
    return with_global_index(points).where(F.col("gidx") < n).select("metric_id", "metric_name", F.col("gidx").alias("i"), "ts", "val")


def evenly(points: DataFrame, n: int) -> DataFrame:
    """(metric_id, metric_name, i, ts, val): n points of each metric, evenly spread, the first and last among them.

    Source index round(i * (length - 1) / (n - 1)), halves away from zero; metrics with fewer than n points give none.
    """
    size = lengths(points).where(F.col("n") >= n)
    wanted = size.select("metric_id", F.col("metric_name").alias("__name"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "n")
    step = (F.col("n") - 1) / F.lit(float(max(n - 1, 1)))
    wanted = wanted.select(F.col("metric_id").alias("__id"), "__name", "i", F.least(F.round(F.col("i") * step).cast("long"), F.col("n") - 1).alias("__gidx"))
    same = (F.col("metric_id") == F.col("__id")) & (F.col("gidx") == F.col("__gidx")) & F.col("metric_name").eqNullSafe(F.col("__name"))
    return with_global_index(points).join(wanted, same).select("metric_id", "metric_name", "i", "ts", "val")


def normalized(points: DataFrame) -> DataFrame:
    """points cut to the length of the shortest metric."""
    least = lengths(points).agg(F.min("n").alias("least"))
    return with_global_index(points).join(F.broadcast(least), F.col("gidx") < F.col("least")).drop("gidx", "least")  # one row


def ladder_rows(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(ppm): the ladder below the points' cap, as a relation and without an action."""
    steps = spark.createDataFrame([(p,) for p in LADDER], "ppm long")
    c = cap(points)
    below = steps.join(F.broadcast(c), F.col("ppm") <= F.col("cap")).select("ppm", "cap")  # one row
    last = c.join(below.agg(F.max("ppm").alias("last"))).where((F.col("cap") > 0) & (F.col("cap") > 1.2 * F.coalesce("last", F.lit(0)))).select(F.col("cap").alias("ppm"))
    return below.select("ppm").unionByName(last)
