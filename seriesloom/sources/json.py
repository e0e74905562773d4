"""JSON imports: column and row layouts, and nested metric documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.errors import CODES
from seriesloom.functions.ids import metric_id

COLUMN_LAYOUT = "metrics array<struct<id: string, name: string, timestamps: array<bigint>, values: array<double>>>"
ROW_LAYOUT = "metrics array<struct<id: string, name: string, points: array<struct<timestamp: bigint, value: double>>>>"
#: Factors from a unit to microseconds; nanoseconds are divided, towards zero.
UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": -1_000}


def to_micros(ts: Column, unit: str) -> Column:
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {', '.join(UNITS)}")
    factor = UNITS[unit]
    return ts * factor if factor > 0 else (F.sign(ts).cast("long") * F.floor(F.abs(ts) / -factor)).cast("long")


def _failed(code: str, what: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {CODES[code]} ({what})"))


def _identified(rows: DataFrame) -> DataFrame:
    """metric_id and metric_name from exactly one of id (an unsigned number) and name."""
    has_id, has_name = F.col("id").isNotNull(), F.col("name").isNotNull() & (F.col("name") != "")
    number = F.col("id").cast("decimal(20,0)")
    signed = F.when(number >= F.lit("9223372036854775808").cast("decimal(20,0)"), (number - F.lit("18446744073709551616").cast("decimal(20,0)")).cast("long")).otherwise(number.cast("long"))
    ident = F.when(has_id & ~has_name, signed).when(has_name & ~has_id, metric_id(F.col("name"))).otherwise(_failed("InvalidInput", "a metric needs either an id or a name").cast("long"))
    return rows.withColumn("metric_id", ident).withColumn("metric_name", F.when(has_name, F.col("name"))).drop("id", "name")


def _increasing(ts: Column) -> Column:
    """The array if each element is larger than the one before, else an error."""
    n = F.size(ts)
    ok = (n < 2) | F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(ts, i) > F.get(ts, i - 1))
    return F.when(ok, ts).otherwise(_failed("InvalidInput", "timestamps must increase").cast("array<bigint>"))


def read_columns(spark: SparkSession, path: str, unit: str = "us") -> DataFrame:
    """(metric_id, metric_name, pos, ts, val) of documents {"metrics": [{"name" or "id", "timestamps": [...], "values": [...]}]}."""
    m = spark.read.schema(COLUMN_LAYOUT).json(path, multiLine=True).select(F.explode("metrics").alias("m")).select("m.*")
    same = F.size("timestamps") == F.size("values")
    ts = F.when(same, _increasing(F.col("timestamps"))).otherwise(_failed("DataPointCountMismatch", "timestamps and values").cast("array<bigint>"))
    rows = _identified(m).select("metric_id", "metric_name", "values", F.posexplode(ts).alias("pos", "t"))
    return rows.select("metric_id", "metric_name", "pos", to_micros(F.col("t"), unit).alias("ts"), F.get("values", F.col("pos")).alias("val"))


def read_rows(spark: SparkSession, path: str, unit: str = "us") -> DataFrame:
    """(metric_id, metric_name, pos, ts, val) of documents {"metrics": [{"name" or "id", "points": [{"timestamp", "value"}]}]}."""
    m = spark.read.schema(ROW_LAYOUT).json(path, multiLine=True).select(F.explode("metrics").alias("m")).select("m.*")
    ts = _increasing(F.transform("points", lambda p: p["timestamp"]))
    rows = _identified(m).select("metric_id", "metric_name", "points", F.posexplode(ts).alias("pos", "t"))
    return rows.select("metric_id", "metric_name", "pos", to_micros(F.col("t"), unit).alias("ts"), F.get("points", F.col("pos"))["value"].alias("val"))


def read_metric_documents(spark: SparkSession, path: str, metrics: str = "MetricValues", name: str = "Name", values: str = "Values", time: str = "t", value: str = "v", attribute: str = "a", unit: str = "us", metadata: tuple[str, ...] = ("ToolID", "ContextID"), lines: bool = False) -> DataFrame:
    """(metadata..., metric_id, metric_name, pos, ts, val, tag) of nested documents whose keys are parameters.

    lines: one document a line, which lets a large file be split; a document of its own is read by one task.
    """
    keys = [metrics, name, values, time, value]
    if not all(keys) or len({name, values}) < 2 or len({time, value}) < 2:
        raise ValueError("every key needs a name of its own")
    inner = f"struct<`{time}`: bigint, `{value}`: double, `{attribute}`: string>"
    schema = ", ".join([*(f"`{k}` string" for k in metadata), f"`{metrics}` array<struct<`{name}`: string, `{values}`: array<{inner}>>>"])
    docs = spark.read.schema(schema).json(path, multiLine=not lines)
    m = docs.select(*metadata, F.explode(metrics).alias("m")).select(*metadata, F.col(f"m.`{name}`").alias("metric_name"), F.posexplode(F.col(f"m.`{values}`")).alias("pos", "p"))
    return m.select(*metadata, metric_id(F.col("metric_name")).alias("metric_id"), "metric_name", "pos", to_micros(F.col(f"p.`{time}`"), unit).alias("ts"), F.col(f"p.`{value}`").alias("val"), F.coalesce(F.col(f"p.`{attribute}`"), F.lit("")).alias("tag"))


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small report as CSV with a header, or as JSON lines."""
    if form == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)
