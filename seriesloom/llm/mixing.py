"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are grouped into blocks. The target is a fluid schedule: at
every instant the sources that have rows left share a slot in proportion to
their weights. Block k of a source may run from the slot in which the target
begins it (its release) and must run by the end of the slot in which the target
completes it (its deadline); in each slot the released block with the earliest
deadline runs. Every source is then always less than one block away from the
target, from the first slot to the last, also after others have ended.

The target in closed form: let V grow so that a source with weight w has run
min(blocks, w * V) blocks. Slot t(V) is the sum of these over all sources, so
block k of a source begins at t(k / w) and ends at t((k + 1) / w). Weights are
whole numbers here, exactly those given, and so is all that follows: nothing is
rounded and no error adds up, however many slots there are.

The schedule, one row for each block (not row) of the corpus, is worked out by
one task that holds a number a source and streams it to the shared folder; the
rows then find their slots by an equi-join.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.ranks import numbered
from seriesloom.runtime import cut, stored

#: Rows of a block; slots written at once.
BLOCK_ROWS, SLOTS_AT_ONCE = 16, 1 << 16
#: Places of rows in the mixed order that are broadcast at most: 12 bytes each.
PLACES = 1 << 22


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratio of the weights, which are above zero."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(x.denominator for x in exact)) if exact else 1
    return [int(x * unit) for x in exact]


class Target:
    """The fluid schedule of sources with `blocks` blocks each and whole weights."""

    def __init__(self, blocks: list[int], weights: list[int]):
        self.weights = weights
        order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
        #: When sources end, in V; from then on, the blocks of those that ended and the weight of the others.
        self.ends, self.done, self.active = [], [0], [sum(weights)]
        for s in order:
            self.ends.append(Fraction(blocks[s], weights[s]))
            self.done.append(self.done[-1] + blocks[s])
            self.active.append(self.active[-1] - weights[s])

    def window(self, s: int, k: int, segment: int) -> tuple[int, int, int]:
        """(release, deadline, segment of the deadline) of block k; segment: one that k / w does not lie before."""
        w = self.weights[s]
        at = self._segment(k, w, segment)
        due = self._segment(k + 1, w, at)
        return self.done[at] + self.active[at] * k // w, self.done[due] - (-self.active[due] * (k + 1) // w), due

    def _segment(self, k: int, w: int, at: int) -> int:
        if at < len(self.ends) and k * self.ends[at].denominator > self.ends[at].numerator * w:
            return bisect_right(self.ends, Fraction(k, w), at)
        return at


def pfair(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int]]:
    """(source, its block) of each slot: released blocks, earliest deadline first."""
    target = Target(blocks, weights)
    waiting = []  # (release, deadline, source, block, segment)
    for s, n in enumerate(blocks):
        if n:
            release, due, segment = target.window(s, 0, 0)
            waiting.append((release, due, s, 0, segment))
    heapq.heapify(waiting)
    ready: list = []  # (deadline, source, block, segment)
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        due, s, k, segment = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        yield s, k
        slot += 1
        if k + 1 < blocks[s]:
            release, due, segment = target.window(s, k + 1, segment)
            if release <= slot:
                heapq.heappush(ready, (due, s, k + 1, segment))
            else:
                heapq.heappush(waiting, (release, due, s, k + 1, segment))


def _schedule(batches: Iterator[pa.RecordBatch], sizes: list[int], weights: list[int], block_rows: int) -> Iterator[pa.RecordBatch]:
    """(number of the source, block, slot, first: rows before the slot)."""
    out: list[list[int]] = [[], [], [], []]
    names = ["s", "k", "slot", "first"]

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], names)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        for _ in range(batch.num_rows):  # one row
            first = 0
            for slot, (s, k) in enumerate(pfair([-(-n // block_rows) for n in sizes], weights)):
                for c, x in zip(out, (s, k, slot, first), strict=True):
                    c.append(x)
                first += min(block_rows, sizes[s] - k * block_rows)
                if len(out[0]) >= SLOTS_AT_ONCE:
                    yield flush()
    if out[0]:
        yield flush()


def mix(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row_no, doc_id, source, block, slot, position: one row per input row, no text read.

    weights: source to weight; a source without one above zero gets the
    smallest given. Without weights a source weighs the square root of its
    rows. A null source is a source of its own. `position` is the row's place
    in the mixed order, 0, 1, ... (the last block of a source may have fewer
    rows than the others). Repeated and null doc_ids are rows like any other;
    an empty table gives an empty result. row_no is the row's number in the
    scan of `docs`. The driver holds a number for each source, not for rows.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source")), "sources")
    counted = sorted(((r.source, r["count"]) for r in rows.groupBy("source").count().collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in counted]
    given = {None if k is None else str(k): w for k, w in (weights or {}).items() if w > 0}
    least = min(given.values(), default=1.0)
    exact = whole_weights([n**0.5 if weights is None else given.get(s, least) for s, n in counted])
    plan = stored(spark.range(0, 1, 1, 1).mapInArrow(lambda it: _schedule(it, sizes, exact, block_rows), "s int, k long, slot long, first long"), "schedule")
    names = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(counted)], "name string, s int")
    plan = plan.join(F.broadcast(names), "s")  # a row a source, as the driver holds them
    by = numbered(rows, "source", "doc_id", "row_no", sum(sizes)).withColumn("block", F.floor(F.col("number") / block_rows))
    placed = by.join(plan, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("k")))
    return placed.select("row_no", "doc_id", "source", "block", "slot", (F.col("first") + F.col("number") % block_rows).alias("position"))


def mixed_rows(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of `docs`, each once, in mixed order: range-partitioned and sorted by position.

    `docs` must be a stored table: it is read more than once.
    """
    order = cut(mix(docs, weights, doc_id, source).select(F.col("row_no").alias("__row_no"), F.col("position").alias("__position")))
    rows = docs.withColumn("__row_no", F.monotonically_increasing_id())
    if order.count() <= PLACES:  # texts are then shuffled once, by their place
        by_word = order.groupBy(F.shiftright("__row_no", 6).alias("__word")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("__row_no").bitwiseAND(63).cast("int").alias("k"), F.col("__position").alias("v")))).alias("__places"))
        rows = rows.withColumn("__word", F.shiftright("__row_no", 6)).join(F.broadcast(by_word), "__word")
        rows = rows.withColumn("__position", F.element_at("__places", F.col("__row_no").bitwiseAND(63).cast("int"))).drop("__row_no", "__word", "__places")
    else:
        rows = rows.join(order, "__row_no").drop("__row_no")
    return rows.repartitionByRange(F.col("__position")).sortWithinPartitions("__position").drop("__position")
