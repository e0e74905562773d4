"""One object for a set of blobs, over the operators of this package.

    s = SeriesSet(points)
    s.all("cpu.usage"), s.value_at("cpu.usage", 7), s.duration("cpu.usage")

Methods return DataFrames, or a plain value where the question is about one
metric. A missing metric gives nothing, none, 0 or false, never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from seriesloom.errors import SeriesError
from seriesloom.operators import lookup, materialize, scan, sets, summary


@dataclass(frozen=True)
class SeriesSet:
    """Numeric or text points of one or more blobs."""

    points: DataFrame

    @classmethod
    def of(cls, *relations: DataFrame) -> SeriesSet:
        """A set of the blobs of some relations; none is an error."""
        return cls(sets.union(*relations))

    # scans
    def all(self, metric: int | str) -> DataFrame:
        return scan.set_scan(self.points, metric)

    def timestamps(self, metric: int | str) -> DataFrame:
        return scan.set_scan(self.points, metric, "timestamps")

    def values(self, metric: int | str) -> DataFrame:
        return scan.set_scan(self.points, metric, "values")

    def tags(self, metric: int | str) -> DataFrame:
        return scan.set_scan(self.points, metric, "tags")

    def iterate(self, metric: int | str, part: str = "all") -> Iterator[tuple]:
        return scan.iterate(self.points, metric, part)

    def for_each(self, metric: int | str, visit: Callable[..., bool], part: str = "all") -> bool:
        return scan.for_each(self.points, metric, visit, part)

    # lookups
    def at(self, metric: int | str, gidx: int) -> Row | None:
        """The whole point at a global index."""
        return lookup.set_at(self.points, metric, gidx).first() if gidx >= 0 else None

    def value_at(self, metric: int | str, gidx: int):
        row = self.at(metric, gidx)
        return row and row.val

    def timestamp_at(self, metric: int | str, gidx: int) -> int | None:
        row = self.at(metric, gidx)
        return row and row.ts

    def tag_at(self, metric: int | str, gidx: int) -> str | None:
        row = self.at(metric, gidx)
        return row.tag if row else None

    def has(self, metric: int | str) -> bool:
        return lookup.has_metric(self.points, metric)

    # listings and summaries
    def metric_ids(self) -> DataFrame:
        return lookup.metric_ids(self.points)

    def metric_names(self) -> DataFrame:
        return lookup.metric_names(self.points)

    def length(self, metric: int | str) -> int:
        return scan.of_metric(self.points, metric).count()

    def duration(self, metric: int | str) -> int:
        row = summary.durations(scan.of_metric(self.points, metric)).first()
        return row.duration_us if row else 0

    def time_range(self) -> tuple[int, int]:
        row = summary.time_range(self.points).first()
        if row.start_us is None:
            raise SeriesError("EmptyBlobSet")
        return row.start_us, row.end_us

    def blobs(self) -> DataFrame:
        return summary.blobs(self.points)

    def blob(self, n: int) -> SeriesSet:
        """The n-th blob in order of start, as a set of its own."""
        return SeriesSet(summary.blob_at(self.points, n))

    # arrays
    def materialize(self, metric: int | str | None = None) -> DataFrame:
        """Series as arrays, kept in memory or on disk until unpersisted."""
        return materialize.materialize(self.points, metric).persist()


@dataclass(frozen=True)
class MixedSet:
    """Numeric and text blobs together; see operators.sets for which side answers."""

    numeric: SeriesSet
    text: SeriesSet

    def _side(self, metric: int | str) -> SeriesSet:
        return self.numeric if self.numeric.has(metric) else self.text

    def timestamps(self, metric: int | str) -> DataFrame:
        return self._side(metric).timestamps(metric)

    def tags(self, metric: int | str) -> DataFrame:
        return self._side(metric).tags(metric)

    def timestamp_at(self, metric: int | str, gidx: int) -> int | None:
        found = self.numeric.timestamp_at(metric, gidx)
        return found if found is not None else self.text.timestamp_at(metric, gidx)

    def tag_at(self, metric: int | str, gidx: int) -> str | None:
        found = self.numeric.tag_at(metric, gidx)
        return found if found is not None else self.text.tag_at(metric, gidx)

    def numeric_at(self, metric: int | str, gidx: int) -> Row | None:
        return self.numeric.at(metric, gidx)

    def text_at(self, metric: int | str, gidx: int) -> Row | None:
        return self.text.at(metric, gidx)

    def length(self, metric: int | str) -> int:
        return self.numeric.length(metric) or self.text.length(metric)

    def duration(self, metric: int | str) -> int:
        return self.numeric.duration(metric) or self.text.duration(metric)

    def is_numeric(self, metric: int | str) -> bool:
        return self.numeric.has(metric)

    def is_text(self, metric: int | str) -> bool:
        return self.text.has(metric)
