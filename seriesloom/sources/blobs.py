"""Blobs as bytes: points to blobs, blobs to points, and a data source for folders of blob files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seriesloom.codecs import blob as B
from seriesloom.codecs.block import LIMIT, NONE
from seriesloom.errors import SeriesError

POINTS = "kind string, blob_id long, blob_start long, blob_ord int, metric_id long, metric_name string, pos int, ts long, val double, text string, tag string"
_FIELDS = pa.schema([("kind", pa.string()), ("blob_id", pa.int64()), ("blob_start", pa.int64()), ("blob_ord", pa.int32()), ("metric_id", pa.int64()), ("metric_name", pa.string()), ("pos", pa.int32()), ("ts", pa.int64()), ("val", pa.float64()), ("text", pa.string()), ("tag", pa.string())])

#: Points of decoded metrics that are put together into a batch.
POINTS_AT_ONCE = 1 << 15


def _signed(ident: int) -> int:
    return ident - (1 << 64) if ident >= 1 << 63 else ident


def encode_blobs(points: DataFrame, config: B.Config | B.TextConfig = B.Config(), names: bool = False) -> DataFrame:
    """(blob_id, blob_start, data): blobs of bytes, one for each blob of a relation of points.

    Only where a blob of points has more metrics or bytes than the format
    allows, it takes several, each with whole metrics. Metrics come in unsigned
    order of their ids. names: key metrics by name where the relation has names.
    A blob whose offsets do not fit the first layout takes the second.

    Points come sorted, so a task holds a batch, one metric's points and the
    bytes of the metrics before it.
    """
    text = isinstance(config, B.TextConfig)
    most = B.MAX_COMPACT if text and names else B.MAX_METRICS
    compressed = config.block != NONE if text else config.ts_block != NONE or config.val_block != NONE
    most_bytes = LIMIT if compressed else B.MAX_BLOB - LIMIT

    def fitting(start: int, packed: list[B.Packed]) -> bytes:
        try:
            return B.join_numeric(start, packed, config)
        except SeriesError as e:
            if config.v2 or e.code != "OffsetOutOfRange":
                raise
            return B.join_numeric(start, packed, replace(config, v2=True))

    def metrics(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        """((blob_id, blob_start, metric_id, metric_name), points) of one metric after the other."""
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy() for k in range(3)] + [batch.column(3).dictionary_encode().indices.fill_null(-1).to_numpy()]
            bounds = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in ids])) + 1).tolist(), batch.num_rows]
            for a, z in zip(bounds, bounds[1:], strict=False):
                new = tuple(batch.column(k)[a].as_py() for k in range(4))
                if parts and new != key:
                    yield key, pa.Table.from_batches(parts)
                    parts = []
                key = new
                parts.append(batch.slice(a, z - a))
        if parts:
            yield key, pa.Table.from_batches(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packed, sizes = None, [], np.zeros(3, np.int64)

        def blob() -> pa.RecordBatch:
            data = B.join_text(at[1], packed, config) if text else fitting(at[1], packed)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([data], pa.binary())], ["blob_id", "blob_start", "data"])

        for (blob_id, start, ident, name), table in metrics(batches):
            val = table["val"].to_pylist() if text else table["val"].to_numpy()
            tags = table["tag"].to_pylist() if config.tags else None
            m = B.Metric(ident % (1 << 64), table["ts"].to_numpy(), val, tags, name if names else None)
            one = B.pack_text(start, m, config) if text else B.pack_numeric(m, config)
            size = np.array([len(one.ts), len(one.val), len(one.tag)])
            if packed and ((blob_id, start) != at or len(packed) >= most or (sizes + size)[:2].max() > most_bytes or (sizes + size).sum() > B.MAX_BLOB - LIMIT or (sizes + size)[2] > LIMIT):
                yield blob()
                packed, sizes = [], np.zeros(3, np.int64)
            at, sizes = (blob_id, start), sizes + size
            packed.append(one)
        if packed:
            yield blob()

    rows = points.select("blob_id", "blob_start", "metric_id", "metric_name", "pos", "ts", "val", *(["tag"] if config.tags else []))
    order = ["blob_id", "blob_start", F.col("metric_id").bitwiseXOR(F.lit(-(1 << 63))), "metric_name", "pos"]
    return rows.repartition("blob_id", "blob_start").sortWithinPartitions(*order).mapInArrow(run, "blob_id long, blob_start long, data binary")


def _points_of(data: bytes, blob_id: int | None, strict: bool) -> Iterator[pa.RecordBatch]:
    """Points of a blob, some metrics at a time; blob_id: none for the blob's start."""
    if not strict and B.kind_of(data) is None:
        return  # not a blob at all: skipped
    blob, metrics = B.decode_each(data)
    numeric, number = blob.kind == "numeric", blob.start if blob_id is None else blob_id

    def batch(ms: list[B.Metric]) -> pa.RecordBatch:
        sizes = [len(m.ts) for m in ms]
        n = sum(sizes)
        same = lambda items, kind: pa.array(items, kind).take(pa.array(np.repeat(np.arange(len(ms)), sizes)))
        tags = [pa.array(m.tags or [""] * k, pa.string()) for m, k in zip(ms, sizes, strict=True)] if blob.has_tags else [pa.array([""] * n, pa.string())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([blob.kind] * n), pa.array(np.full(n, number)), pa.array(np.full(n, blob.start)), pa.array(np.zeros(n, np.int32)), same([_signed(m.ident) for m in ms], pa.int64()),
                same([m.name for m in ms], pa.string()), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])), pa.array(np.concatenate([m.ts for m in ms])),
                pa.array(np.concatenate([m.val for m in ms])) if numeric else pa.nulls(n, pa.float64()), pa.nulls(n, pa.string()) if numeric else pa.array([v for m in ms for v in m.val], pa.string()), pa.concat_arrays(tags),
            ],
            schema=_FIELDS,
        )

    some, n = [], 0
    for m in metrics:
        some.append(m)
        n += len(m.ts)
        if n >= POINTS_AT_ONCE:
            yield batch(some)
            some, n = [], 0
    if some:
        yield batch(some)


def decode_blobs(blobs: DataFrame, data: str = "data", blob_id: str = "blob_id", strict: bool = True) -> DataFrame:
    """Points of blobs given as bytes. strict=False skips bytes that are no blob; damaged blobs are always an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _points_of(raw.as_py(), i, strict)

    return blobs.select(F.col(blob_id).cast("long"), F.col(data)).mapInArrow(run, POINTS)


def blob_headers(blobs: DataFrame, data: str = "data", blob_id: str = "blob_id") -> DataFrame:
    """(blob_id, kind, blob_start, layout, encodings, flags, n_metrics, n_points, n_bytes) of blobs given as bytes."""
    schema = "blob_id long, kind string, blob_start long, layout string, ts_enc string, val_enc string, has_tag boolean, has_names boolean, big_endian boolean, n_metrics long, n_points long, n_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = B.decode(raw.as_py())
                out.append({"blob_id": i, "kind": b.kind, "blob_start": b.start, "layout": b.layout, "ts_enc": B.NAMES[b.ts_encoding], "val_enc": B.NAMES[b.val_encoding], "has_tag": b.has_tags, "has_names": b.has_names, "big_endian": b.big_endian, "n_metrics": len(b.metrics), "n_points": sum(len(m.ts) for m in b.metrics), "n_bytes": b.size})
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return blobs.select(F.col(blob_id).cast("long"), F.col(data)).mapInArrow(run, schema)


def read_blob_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Points of a folder of blob files through Spark's own binary reader, one blob a file; blob_id is the start of the blob.

    Files whose first bytes are no blob's are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.xxhash64("path").alias("blob_id"), F.col("content").alias("data"))
    return decode_blobs(files, strict=strict).withColumn("blob_id", F.col("blob_start"))


class BlobSource(DataSource):
    """spark.read.format("seriesblob").load(folder) for folders that the executors mount; elsewhere use read_blob_files."""

    @classmethod
    def name(cls) -> str:
        return "seriesblob"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> DataSourceReader:
        return _BlobReader(self.options)


class _BlobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).rglob("*")) if p.is_file() and not p.name.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            data = f.read()
        yield from _points_of(data, None, False)


def column_bytes(points: DataFrame, codec: str) -> DataFrame:
    """(metric_id, metric_name, blob_id, n, bytes, n_mismatch): each value column encoded and read back.

    codec: raw, gorilla, chimp or alp. n_mismatch counts values whose bits differ, which should be none.
    """
    kind = {"raw": B.RAW, "gorilla": B.GORILLA, "chimp": B.CHIMP, "alp": B.ALP}[codec]

    def encode(table: pa.Table) -> pa.Table:
        v = table.sort_by("pos")["val"].to_numpy()
        data = B.value_bytes(v, kind)
        back = B.value_from(data, len(v), kind)
        bad = int((back.view(np.uint64) != v.view(np.uint64)).sum())
        return pa.table({"metric_id": [table["metric_id"][0].as_py()], "metric_name": [table["metric_name"][0].as_py()], "blob_id": [table["blob_id"][0].as_py()], "n": [len(v)], "bytes": [len(data)], "n_mismatch": [bad]})

    rows = points.select("metric_id", "metric_name", "blob_id", "pos", "val")
    return rows.groupBy("metric_id", "blob_id").applyInArrow(encode, "metric_id long, metric_name string, blob_id long, n long, bytes long, n_mismatch long")
