"""Sets of numeric and text blobs together.

Three rules decide which side answers for a metric that both have:
iteration takes text only for metrics that no numeric blob has; a lookup falls
through to text where the numeric side has no such index; lengths and
durations fall through where the numeric one is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import SeriesError
from seriesloom.operators.lookup import at_indexes
from seriesloom.operators.scan import set_scan
from seriesloom.operators.summary import durations, lengths


def union(*sets: DataFrame, typed: bool = True) -> DataFrame:
    """One set of all blobs of some sets of one kind; overlapping blobs stay apart, one after the other."""
    if not sets:
        raise SeriesError("EmptyBlobSet") if typed else ValueError("no set given")
    return reduce(DataFrame.unionByName, sets)


def _only_text(numeric: DataFrame, text: DataFrame) -> DataFrame:
    return text.join(numeric.select("metric_id").distinct(), "metric_id", "left_anti")


def timestamps(numeric: DataFrame, text: DataFrame) -> DataFrame:
    """(metric_id, metric_name, gidx, ts) of all metrics, numeric ones first."""
    return set_scan(numeric, part="timestamps").unionByName(set_scan(_only_text(numeric, text), part="timestamps"))


def tags(numeric: DataFrame, text: DataFrame) -> DataFrame:
    """(metric_id, metric_name, gidx, tag); a point without a tag has ''."""
    return set_scan(numeric, part="tags").unionByName(set_scan(_only_text(numeric, text), part="tags"))


def lookup(numeric: DataFrame, text: DataFrame, indexes: list[int]) -> DataFrame:
    """(metric_id, metric_name, gidx, ts, tag) at some indexes: the numeric point if there is one, else the text one."""
    n, t = (at_indexes(p, indexes).select("metric_id", "metric_name", "gidx", "ts", "tag") for p in (numeric, text))
    return n.unionByName(t.join(n.select("metric_id", "gidx"), ["metric_id", "gidx"], "left_anti"))


def _fall_through(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    a, b = (x.select("metric_id", "metric_name", F.col(column)) for x in (a, b))
    joined = a.join(b.select("metric_id", F.col("metric_name").alias("__name"), F.col(column).alias("__other")), "metric_id", "full")
    return joined.select("metric_id", F.coalesce("metric_name", "__name").alias("metric_name"), F.coalesce(F.nullif(F.col(column), F.lit(0)), F.col("__other"), F.lit(0)).alias(column))


def mixed_lengths(numeric: DataFrame, text: DataFrame) -> DataFrame:
    return _fall_through(lengths(numeric), lengths(text), "n")


def mixed_durations(numeric: DataFrame, text: DataFrame) -> DataFrame:
    return _fall_through(durations(numeric), durations(text), "duration_us")


def kinds(numeric: DataFrame, text: DataFrame) -> DataFrame:
    """(metric_id, metric_name, is_numeric, is_text): which sides have a metric."""
    both = numeric.select("metric_id", "metric_name", F.lit(True).alias("is_n")).distinct().unionByName(text.select("metric_id", "metric_name", F.lit(False).alias("is_n")).distinct())
    return both.groupBy("metric_id", "metric_name").agg(F.bool_or("is_n").alias("is_numeric"), F.bool_or(~F.col("is_n")).alias("is_text"))
