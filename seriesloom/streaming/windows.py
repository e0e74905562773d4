"""Streams of points into blobs: one blob for each window of event time.

The reference relation is built from finished windows only; a point that is
later than the watermark is dropped by the engine, as its blob is sealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_summary(stream: DataFrame, time: str = "ts", metric: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(blob_start, metric_name, n, first_ts, last_ts, total) of each finished window: the index of the blobs to come."""
    w = F.window(F.col(time), window)
    rows = stream.withWatermark(time, late).groupBy(w.alias("w"), F.col(metric).alias("metric_name"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.sum(value).alias("total")).select(F.unix_micros(F.col("w.start")).alias("blob_start"), "metric_name", "n", F.unix_micros("first_ts").alias("first_ts"), F.unix_micros("last_ts").alias("last_ts"), "total")


def windowed_series(stream: DataFrame, order: Column, time: str = "ts", metric: str = "event_type", value: str = "value", tag: str | None = None, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(blob_start, metric_name, points) of each finished window; points: array of (ts, val, tag) by time and `order`.

    A metric's points of one window are the state of one key.
    """
    point = F.struct(F.unix_micros(time).alias("ts"), order.alias("__order"), F.col(value).alias("val"), (F.coalesce(F.col(tag), F.lit("")) if tag else F.lit("")).alias("tag"))
    rows = stream.withWatermark(time, late).groupBy(F.window(F.col(time), window).alias("w"), F.col(metric).alias("metric_name"))
    series = rows.agg(F.array_sort(F.collect_list(point)).alias("p"))
    return series.select(F.unix_micros(F.col("w.start")).alias("blob_start"), "metric_name", F.transform("p", lambda x: F.struct(x["ts"], x["val"], x["tag"])).alias("points"))


def to_parquet(finished: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a Parquet table, each exactly once."""
    return finished.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_windows(spark: SparkSession, path: str, **parameters: str) -> DataFrame:
    """window_summary of a Parquet folder or file, streamed once to its end, and the windows that the watermark leaves open.

    For tables that have an end: what is still open then is taken from a batch
    pass over the same rows, so that the result is that of the whole table.
    """
    import uuid

    from seriesloom.runtime import shared_dir

    batch = spark.read.parquet(path)
    time = parameters.get("time", "ts")
    utc = F.to_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone())
    table = batch.withColumn(time, utc)
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rstrip("/").rpartition("/")
    one_file = any(f.rstrip("/").endswith(f"/{name}") for f in batch.inputFiles()[:1])
    reader = spark.readStream.schema(batch.schema)
    source = (reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)).withColumn(time, utc)
    to_parquet(window_summary(source, **parameters), f"{base}/table", f"{base}/state").awaitTermination()
    whole = window_summary(table, **parameters)
    done = spark.read.schema(whole.schema).parquet(f"{base}/table")
    return done.unionByName(whole.join(done, ["blob_start", "metric_name"], "left_anti"))
