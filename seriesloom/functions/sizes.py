"""Encoded sizes of timestamp columns and blobs as column expressions, without encoding anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a blob's header, of an index entry, and of one in the extended form.
HEADER, ENTRY, WIDE_ENTRY = 32, 16, 32
#: Largest offset or count of a compact index entry.
MAX_COMPACT = 65_535


def zigzag(x: Column) -> Column:
    """Signed to unsigned (as the bits of a long): small numbers of either sign become small."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def varint_bytes(u: Column) -> Column:
    """Bytes of an unsigned LEB128 number given as the bits of a long."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(u < (1 << (7 * n)), n).otherwise(out)
    return F.when(u < 0, 10).otherwise(out)


def group_bytes(u: Column) -> Column:
    """Data bytes of a number in a group of four: 1, 2, 4 or 8."""
    return F.when(u < 0, 8).when(u < 1 << 8, 1).when(u < 1 << 16, 2).when(u < 1 << 32, 4).otherwise(8)


def timestamp_steps(points: DataFrame) -> DataFrame:
    """points with d (difference to the point before in the blob's column) and dd (its difference); null where there is none."""
    w = Window.partitionBy("metric_id", "blob_id").orderBy("pos")
    return points.withColumn("d", F.col("ts") - F.lag("ts").over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))


def timestamp_bytes(points: DataFrame) -> DataFrame:
    """(metric_id, metric_name, blob_id, n, raw, delta, packed): bytes of each column under the three timestamp codecs."""
    steps = timestamp_steps(points)
    start = F.when(F.col("d").isNull(), varint_bytes(F.col("ts"))).when(F.col("dd").isNull(), varint_bytes(zigzag(F.col("d"))))
    z = zigzag(F.col("dd"))
    n = F.count(F.lit(1))
    groups = F.greatest(F.lit(0), F.ceil((n - 2) / 4))
    return steps.groupBy("metric_id", "metric_name", "blob_id").agg(
        n.alias("n"),
        (n * 8).alias("raw"),
        F.sum(F.coalesce(start, varint_bytes(z))).alias("delta"),
        (F.sum(F.coalesce(start, group_bytes(z))) + groups).alias("packed"),
    )


def sequences(points: DataFrame) -> DataFrame:
    """(metric_id, blob_id, seq): each column's timestamps as an array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ts"))), lambda x: x["ts"])
    return points.groupBy("metric_id", "blob_id").agg(ordered.alias("seq"))


def shared_groups(points: DataFrame) -> DataFrame:
    """(blob_id, seq_n, members, canonical): columns of a blob with the same timestamps, two at least.

    Grouped by the array itself, so nothing is left to verify. canonical: the smallest unsigned id.
    """
    unsigned = F.col("metric_id").bitwiseXOR(F.lit(-(1 << 63)))
    g = sequences(points).groupBy("blob_id", "seq").agg(F.count(F.lit(1)).alias("members"), F.min_by("metric_id", unsigned).alias("canonical"))
    return g.where("members > 1").select("blob_id", F.size("seq").alias("seq_n"), "members", "canonical")


def shared_table_bytes(points: DataFrame) -> DataFrame:
    """(blob_id, bytes): size of a blob's table of shared timestamps; blobs without sharing have no row."""
    return shared_groups(points).groupBy("blob_id").agg((F.lit(2) + F.sum(F.lit(4) + 2 * (F.col("members") - 1))).alias("bytes"))


def blob_bytes(columns: DataFrame, ts: str = "raw", val: str = "val_bytes", entry: int = ENTRY) -> DataFrame:
    """(blob_id, n_metrics, n_points, bytes, bpp) of blobs without names, tags or block compression; columns: one row per (blob, metric)."""
    g = columns.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n_metrics"), F.sum("n").alias("n_points"), F.sum(F.col(ts) + F.col(val)).alias("payload"))
    size = F.lit(HEADER) + entry * F.col("n_metrics") + F.col("payload")
    return g.select("blob_id", "n_metrics", "n_points", size.alias("bytes"), (size / F.col("n_points")).alias("bpp"))


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Compressed by original; 0 for nothing."""
    return F.when(original == 0, 0.0).otherwise(compressed / original)


def space_savings(original: Column, compressed: Column) -> Column:
    """Percent saved."""
    return (1 - compression_ratio(original, compressed)) * 100


def max_points(ts_encoding: str = "delta", val_encoding: str = "gorilla", wide: bool = False) -> int:
    """Points that a metric may surely have before a compact index overflows."""
    if wide:
        return (1 << 32) - 1
    ts = {"raw": 8, "packed": 5}.get(ts_encoding, 9)
    return MAX_COMPACT // max(ts, 8 if val_encoding == "raw" else 9)
