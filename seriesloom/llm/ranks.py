"""Row numbers inside groups without gathering a group in one task.

Rows of a group are dealt by the leading bits of a hash into buckets of a
bounded mean size; a bucket's first number is the sum of the buckets before it,
and rows are numbered by a window over the bucket. The order is a fixed
pseudo-random one: by hash of key and row number, then by key and row number.
Rows of one key, null or not, are so spread like any others. The sums go over
two levels, so that no task adds up more than 2**STEP of them for each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Mean rows of a bucket; leading bits of a bucket that the lower level of sums leaves out.
BUCKET_ROWS, STEP = 2_000, 12


def _before(df: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    return df.withColumn("__before", F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def numbered(df: DataFrame, group: str, key: str, row_no: str, n_rows: int, number: str = "number", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with `number`: 0, 1, ... inside each value of `group`.

    row_no: a distinct long of each row; df must be a stored table, as it is
    read more than once. n_rows: rows of df, at least roughly.
    """
    bits = max(1, (max(n_rows, 1) // bucket_rows).bit_length())
    rows = df.withColumn("__hash", F.xxhash64(key, row_no)).withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bits))
    counts = rows.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__high", F.shiftright("__bucket", STEP))  # a group has 2**bits rows here at most
    low = _before(counts, [group, "__high"], "__bucket", "__n")
    high = _before(counts.groupBy(group, "__high").agg(F.sum("__n").alias("__n")), [group], "__high", "__n")
    high = high.select(F.col(group).alias("__g"), F.col("__high").alias("__h"), F.col("__before").alias("__base"))
    starts = low.join(high, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__high") == F.col("__h")))
    starts = starts.select(F.col(group).alias("__group"), F.col("__bucket").alias("__start_bucket"), (F.col("__base") + F.col("__before")).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy("__hash", key, row_no))
    joined = rows.withColumn("__own", own).join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__bucket") == F.col("__start_bucket")))
    return joined.withColumn(number, F.col("__start") + F.col("__own") - 1).drop("__hash", "__bucket", "__own", "__group", "__start_bucket", "__start")


def numbered_in_order(df: DataFrame, group: str, part: str, place: str, number: str = "number") -> DataFrame:
    """df with `number`: 0, 1, ... inside each value of `group`, by part and then place.

    place: distinct inside a part, whose rows of a group are numbered by one
    task. df must be a stored table, as it is read more than once.
    """
    counts = _before(df.groupBy(group, part).agg(F.count(F.lit(1)).alias("__n")), [group], part, "__n")  # a group has a row a part here at most
    starts = counts.select(F.col(group).alias("__group"), F.col(part).alias("__part"), F.col("__before").alias("__start"))
    own = F.row_number().over(Window.partitionBy(group, part).orderBy(place))
    joined = df.withColumn("__own", own).join(starts, F.col(group).eqNullSafe(F.col("__group")) & F.col(part).eqNullSafe(F.col("__part")))
    return joined.withColumn(number, F.col("__start") + F.col("__own") - 1).drop("__own", "__group", "__part", "__start")
