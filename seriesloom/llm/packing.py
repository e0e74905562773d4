"""Packing into optimal length buckets.

A global histogram of lengths (one row per distinct length, summed before the
shuffle) goes to the driver, where dynamic programming chooses the bucket
boundaries with the least padding: every row is padded to its bucket's
boundary. Inside a bucket, rows form batches of at most `budget` tokens.

The histogram's size is bounded: up to EXACT every length counts for itself,
longer ones share geometric bins GRAIN to a doubling (boundaries are then
chosen among bin ends; no row is left out or cut).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.ranks import numbered, numbered_in_order
from seriesloom.runtime import stored

#: Buckets, tokens of a batch.
BUCKETS, BUDGET = 16, 65_536
#: Lengths that have a histogram entry of their own; bins to a doubling beyond.
EXACT, GRAIN = 2048, 256


def n_words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bin_end(length: Column) -> Column:
    """The largest length in the histogram bin of `length`."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT)).cast("double")))) / GRAIN
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding. lengths: ascending and distinct.

    cost(i, j): bins i to j - 1 padded to lengths[j - 1]; the last bound is the largest length.
    """
    n = len(lengths)
    if n == 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    ends = lengths.astype(np.float64)
    choice = []
    for _ in range(min(buckets, n)):
        # Padded tokens of bins i..j-1 are ends[j-1] * (total[j] - total[i]); the tokens themselves do not depend on the choice.
        row, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + ends[j - 1] * (total[j] - total[:j])
            back[j] = int(np.argmin(cost))
            row[j] = cost[back[j]]
        row[0] = 0
        better = row < best
        row, back = np.where(better, row, best), np.where(better, back, -1)
        choice.append(back)
        best = row
    out, j, k = [], n, len(choice) - 1
    while j > 0:
        while k > 0 and choice[k][j] < 0:
            k -= 1
        out.append(int(lengths[j - 1]))
        j, k = int(choice[k][j]), k - 1
    return out[::-1]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, order: tuple[Column, Column] | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch, place: one row per input row.

    n_tokens is `length`, by default the number of words. A batch of a bucket
    has max(1, budget // padded_length) places; only a text longer than the
    budget is a batch beyond it, alone. Empty and null texts have length 0 and
    are padded to their bucket's boundary like any other. Repeated and null
    doc_ids are rows like any other, each with a place of its own; rows of one
    doc_id and bucket take their places by row number in the scan. An empty
    table gives an empty result.

    order: (part, place) of each row, distinct, as of runtime.written_order().
    A bucket's rows then fill its batches by part and place; without it they do
    so in a fixed pseudo-random order.
    """
    words = n_words(F.col(text)) if length is None else length.cast("long")
    at = [] if order is None else [order[0].alias("part"), order[1].alias("at")]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), words.alias("n_tokens"), *at), "lengths")  # texts are read once
    histogram = sorted(rows.groupBy(bin_end(F.col("n_tokens")).alias("end")).agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("top")).collect())
    tops = np.array([r.top for r in histogram], np.int64)  # a bin's longest row
    counts = np.array([r.n for r in histogram], np.int64)
    bounds = boundaries(tops, counts, buckets)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, bound in reversed(list(enumerate(bounds))):  # at most `buckets` branches
        fits = F.col("n_tokens") <= bound
        bucket, padded = F.when(fits, F.lit(i)).otherwise(bucket), F.when(fits, F.lit(bound).cast("long")).otherwise(padded)
    held = rows.withColumns({"bucket": bucket, "padded_length": padded})
    held = held.withColumn("places", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))))
    ranked = numbered(held, "bucket", "doc_id", "row_no", int(counts.sum())) if order is None else numbered_in_order(held, "bucket", "part", "at")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_length",
        F.floor(F.col("number") / F.col("places")).alias("batch"),
        (F.col("number") % F.col("places")).alias("place"),
    )
