"""Cost per point against chunk length, measured and modelled, of a whole set or of each blob."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.sizes import ENTRY, HEADER
from seriesloom.operators.regression import fits, formula, ranked
from seriesloom.operators.resample import LADDER, cap, ladder
from seriesloom.operators.sizing import TIMES, VALUES, chunked_sizes, column_sizes, measured, with_heads


def analyze(points: DataFrame, ts: str = "delta", val: str = "gorilla") -> DataFrame:
    """(rank, model, a, b, c, r2, rmse, n, formula) of the union of all blobs; empty for under two chunk lengths.

    The only value that the driver reads is the cap of the ladder.
    """
    row = cap(points).first()
    steps = ladder(row["cap"] or 0) if row else []
    if not steps:
        steps = [1]
    return _modelled(measured(points, steps, ts, val), [])


def measured_each(points: DataFrame, ts: str = "delta", val: str = "gorilla") -> DataFrame:
    """(blob_id, ppm, n_points, bytes, bpp): each blob re-chunked by itself, with a ladder of its own."""
    n = points.groupBy("blob_id", "metric_id").agg(F.count(F.lit(1)).alias("n"))
    mean, p90 = F.floor(F.avg("n")), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long")
    caps = n.groupBy("blob_id").agg(F.greatest(F.lit(1), F.least(mean, p90)).alias("cap"))
    below = F.filter(F.array(*[F.lit(p).cast("long") for p in LADDER]), lambda p: p <= F.col("cap"))
    steps = F.when(F.col("cap") > 1.2 * F.element_at(below, -1), F.concat(below, F.array("cap"))).otherwise(below)
    lengths = caps.select("blob_id", F.explode(steps).alias("ppm"))
    if (ts, val) == ("delta", "gorilla"):
        own = caps.select("blob_id", F.when(F.col("cap") > 1.2 * F.element_at(below, -1), F.col("cap")).alias("__own"))
        sizes = chunked_sizes(points.select("blob_id", "metric_id", "metric_name", "pos", "ts", "val").join(own, "blob_id"), ["blob_id"], "pos", LADDER, "__own")
        counts = points.groupBy("blob_id", "metric_id", "metric_name").agg(F.count(F.lit(1)).alias("n")).join(lengths, "blob_id")
        return with_heads(sizes, counts, ["blob_id", "ppm"])
    rows = points.select("blob_id", "metric_id", "metric_name", "pos", "ts", "val").join(lengths, "blob_id")
    rows = rows.withColumns({"chunk": F.floor(F.col("pos") / F.col("ppm")), "chunk_pos": F.col("pos") % F.col("ppm")})
    columns = column_sizes(rows, ["blob_id", "ppm", "chunk"], TIMES[ts], VALUES[val])
    blobs = columns.groupBy("blob_id", "ppm", "chunk").agg(F.sum("n").alias("n"), (F.sum("bytes") + HEADER + ENTRY * F.count(F.lit(1))).alias("bytes"))
    return blobs.groupBy("blob_id", "ppm").agg(F.sum("n").alias("n_points"), F.sum("bytes").alias("bytes")).withColumn("bpp", F.col("bytes") / F.col("n_points"))


def analyze_each(points: DataFrame, ts: str = "delta", val: str = "gorilla") -> DataFrame:
    """analyze for each blob by itself: (blob_id, rank, model, ...)."""
    return _modelled(measured_each(points, ts, val), ["blob_id"])


def _modelled(sizes: DataFrame, keys: list[str]) -> DataFrame:
    out = ranked(fits(sizes, keys=keys), keys)
    return out.select(*keys, "rank", "model", "a", "b", "c", "r2", "rmse", "n", formula(F.col("model"), F.col("a"), F.col("b"), F.col("c")).alias("formula"))
