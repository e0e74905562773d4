"""Blob container: scenarios by formula, access, corruption."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seriesloom.codecs import blob as B
from seriesloom.codecs import block
from seriesloom.errors import SeriesError
from seriesloom.sources import blobs as S

BASE = 1_704_067_200_000_000


def numeric(metrics, points, names=False, jitter=False, base_id=1000):
    out = []
    for m in range(metrics):
        i = np.arange(points)
        ts = BASE + i * 60_000_000 + (((i % 5) - 2) * 1000 if jitter else 0)
        name = f"metric.{m:02d}" if names else None
        ident = xxh64_intdigest(name.encode()) if names else base_id + 7 * m
        out.append(B.Metric(ident, ts, 100 * m + i + 0.5, [f"host=server{(m + k) % 10:02d}" for k in range(points)], name))
    return out


def text(metrics, points, names=False):
    out = []
    for m in range(metrics):
        ts = BASE + np.arange(points) * 30_000_000
        name = f"text.metric.{m:02d}" if names else None
        out.append(B.Metric(xxh64_intdigest(name.encode()) if names else 2000 + 13 * m, ts, [f"state_{i:02d}_metric{m}" for i in range(points)], [f"t{i}" if i else "" for i in range(points)], name))
    return out


SCENARIOS = [
    (5, 10, {}, B.Config()), (5, 10, {}, B.Config(ts_block=block.ZSTD, val_block=block.ZSTD)), (3, 8, {}, B.Config(B.RAW, B.RAW)), (3, 8, {}, B.Config(B.RAW, B.RAW, val_block=block.ZSTD)),
    (3, 5, {}, B.Config(tags=True)), (3, 5, {"names": True}, B.Config(tags=True)), (5, 10, {"names": True}, B.Config()), (1, 1, {}, B.Config()), (50, 5, {}, B.Config()),
    (3, 5, {}, B.Config(big_endian=True)), (3, 5, {}, B.Config(B.RAW, B.ALP, big_endian=True, tags=True)), (5, 15, {"jitter": True}, B.Config()), (5, 10, {}, B.Config(v2=True)), (5, 10, {}, B.Config(val=B.CHIMP, v2=True)),
    (5, 10, {}, B.Config(B.DELTA_PACKED, v2=True)), (5, 10, {}, B.Config(shared=True)), (5, 10, {}, B.Config(val=B.CHIMP, shared=True)), (3, 5, {}, B.Config(tags=True, v2=True)), (8, 12, {}, B.Config(B.DELTA_PACKED, shared=True)),
    (5, 15, {"jitter": True}, B.Config(shared=True, big_endian=True)), (2, 20_000, {}, B.Config(B.RAW, B.RAW, v2=True)),
]


@pytest.mark.parametrize("n", range(len(SCENARIOS)))
def test_numeric_scenarios(n):
    metrics, points, how, config = SCENARIOS[n]
    made = numeric(metrics, points, **how)
    data = B.encode_numeric(BASE, made, config)
    back = B.decode(data)
    assert (back.kind, back.start, len(back.metrics), back.has_tags) == ("numeric", BASE, metrics, config.tags)
    by_id = {m.ident: m for m in back.metrics}
    for m in made:
        got = by_id[m.ident]
        assert got.ts.tolist() == m.ts.tolist() and got.val.tolist() == m.val.tolist() and (got.tags == m.tags if config.tags else got.tags is None)
    if config.v2:
        assert [m.ident for m in back.metrics] == sorted(by_id)
    assert back.layout == ("v2ext" if points > 9000 else "v2" if config.v2 else "v1") and back.extra["shared"] == (config.shared and metrics > 1)


@pytest.mark.parametrize("config", [B.TextConfig(), B.TextConfig(tags=True), B.TextConfig(block=block.NONE), B.TextConfig(ts=B.RAW, big_endian=True), B.TextConfig(ts=B.RAW, tags=True)])
@pytest.mark.parametrize("names", [False, True])
def test_text_scenarios(config, names):
    made = text(3, 5, names)
    back = B.decode(B.encode_text(BASE, made, config))
    for m, got in zip(made, back.metrics, strict=True):
        assert (got.ident, got.ts.tolist(), got.val, got.name) == (m.ident, m.ts.tolist(), m.val, m.name)
        assert got.tags == (m.tags if config.tags else None)


def test_sizes_by_formula():
    flat = [B.Metric(i + 1, np.arange(200) * 10**6 + BASE, np.random.default_rng(i).random(200)) for i in range(200)]
    assert len(B.encode_numeric(BASE, flat, B.Config(B.RAW, B.RAW))) == 32 + 200 * 16 + 200 * 200 * 16
    shared = B.encode_numeric(BASE, flat, B.Config(B.RAW, B.RAW, shared=True))
    assert len(shared) == 32 + 200 * 16 + 2 + 4 + 2 * 199 + 200 * 8 + 200 * 200 * 8


def test_empty_tags_are_dropped():
    m = [B.Metric(5, np.array([1, 2]), np.array([1.0, 2.0]), ["", ""])]
    assert not B.decode(B.encode_numeric(0, m, B.Config(tags=True))).has_tags


def test_collisions_keep_names():
    a, b = B.Metric(9, np.array([1]), np.array([1.0]), None, "x"), B.Metric(9, np.array([2]), np.array([2.0]), None, "y")
    data = B.encode_numeric(0, [a, b])
    with pytest.raises(SeriesError, match="HashMismatch"):
        B.decode(data)  # the names are stored, and these do not hash to 9


@pytest.mark.parametrize(
    "code, metrics",
    [
        ("NoMetricsAdded", []),
        ("InvalidMetricID", [B.Metric(0, np.array([1]), np.array([1.0]))]),
        ("NoDataPointsAdded", [B.Metric(1, np.array([], int), np.array([]))]),
        ("DataPointCountMismatch", [B.Metric(1, np.array([1, 2]), np.array([1.0]))]),
        ("HashCollision", [B.Metric(1, np.array([1]), np.array([1.0]))] * 2),
        ("InvalidMetricName", [B.Metric(1, np.array([1]), np.array([1.0]), None, "")]),
        ("InvalidMetricName", [B.Metric(1, np.array([1]), np.array([1.0]), None, "a")] * 2),
        ("MixedIdentifierMode", [B.Metric(1, np.array([1]), np.array([1.0]), None, "a"), B.Metric(2, np.array([1]), np.array([1.0]))]),
        ("OffsetOutOfRange", numeric(2, 20_000)),
    ],
)
def test_writer_errors(code, metrics):
    with pytest.raises(SeriesError) as e:
        B.encode_numeric(0, metrics, B.Config(B.RAW, B.RAW))
    assert e.value.code == code


def test_text_limits():
    with pytest.raises(SeriesError, match="ValueTooLong"):
        B.encode_text(0, [B.Metric(1, np.array([1]), ["é" * 128])])
    with pytest.raises(SeriesError, match="UnsupportedEncoding"):
        B.TextConfig(ts=B.DELTA_PACKED)
    with pytest.raises(SeriesError, match="UnsupportedCompression"):
        B.encode_numeric(0, numeric(1, 2), B.Config(ts_block=9))
    with pytest.raises(SeriesError, match="OffsetOutOfRange"):
        B.encode_text(0, [B.Metric(1, np.arange(65_536), ["v"] * 65_536)])


@pytest.mark.parametrize("kind", [block.S2, block.LZ4])
@pytest.mark.parametrize("data", [b"x", b"a" * 100_000, bytes(range(256)) * 9, b"abcab" * 400, np.random.default_rng(1).bytes(5000)])
def test_block_round_trip(kind, data):
    assert block.decompress(block.compress(data, kind), kind) == data
    assert block.compress(b"", kind) == b"" == block.decompress(b"", kind)


@pytest.mark.parametrize("kind", [block.S2, block.LZ4])
def test_damaged_blocks_are_errors(kind):
    packed = block.compress(b"some text " * 100, kind)
    with pytest.raises(SeriesError):
        block.decompress(packed[:-3], kind)
    with pytest.raises(SeriesError, match="Decompressed"):
        block.decompress(b"\xff\xff\xff\xff\x0f" if kind == block.S2 else b"\x1fa\x01\x00" + b"\xff" * 600_000 + b"\x00\x00", kind)


def test_blobs_with_compressed_sections():
    for kind in (block.S2, block.LZ4):
        data = B.encode_numeric(0, numeric(2, 50), B.Config(ts_block=kind, val_block=kind))
        back = B.decode(data)
        assert all((a.ts == b.ts).all() and (a.val == b.val).all() for a, b in zip(back.metrics, numeric(2, 50), strict=True))


@pytest.mark.parametrize("data", [B.encode_numeric(BASE, numeric(5, 10), B.Config(val=B.ALP, tags=True)), B.encode_numeric(BASE, numeric(5, 10), B.Config(shared=True)), B.encode_text(BASE, text(3, 5, True), B.TextConfig(block=block.NONE))])
def test_damage_is_an_error_or_harmless(data):
    for n in (0, 1, 16, 31, 40, len(data) // 2):
        with pytest.raises(SeriesError):
            B.decode(data[:n])
    for bad in (bytes(len(data)), b"\xff" * len(data), b"\x12\x34" + data[2:], data[:12] + b"\xff\xff\xff\x7f" + data[16:]):
        with pytest.raises(SeriesError):
            B.decode(bad)
    rng = np.random.default_rng(3)
    for _ in range(300):
        flipped = bytearray(data)
        flipped[rng.integers(len(data))] ^= 1 << int(rng.integers(8))
        try:
            B.decode(bytes(flipped))
        except SeriesError:
            pass  # nothing else may come out


def test_points_to_blobs_and_back(spark, tmp_path):
    from seriesloom.model import COLUMNS

    rows = [("numeric", b, BASE + b * 10**9, 0, ident, None, p, BASE + b * 10**9 + p * 1000, p / 4 + ident, "a" if p % 2 else "") for b in range(3) for ident in (5, -3, 77) for p in range(6 + b)]
    points = spark.createDataFrame(rows, "kind string, blob_id long, blob_start long, blob_ord int, metric_id long, metric_name string, pos int, ts long, val double, tag string")
    made = S.encode_blobs(points, B.Config(tags=True, shared=True))
    back = S.decode_blobs(made).drop("text").select(COLUMNS)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, points.collect()), key=str)
    heads = {r.blob_id: r for r in S.blob_headers(made).collect()}
    assert heads[2].n_points == 24 and heads[0].n_metrics == 3 and heads[0].layout == "v2"
    for r in made.collect():
        (tmp_path / f"{r.blob_id}.blob").write_bytes(r.data)
    (tmp_path / "note.txt").write_text("no blob")
    spark.dataSource.register(S.BlobSource)
    for read in (spark.read.format("seriesblob").load(str(tmp_path)), S.read_blob_files(spark, str(tmp_path))):
        assert sorted((r.metric_id, r.ts, r.val) for r in read.collect()) == sorted((r[4], r[7], r[8]) for r in rows)


def test_value_columns_round_trip(spark):
    points = spark.createDataFrame([(1, "m", 0, p, v) for p, v in enumerate([float("nan"), -0.0, 0.0, 1.25, float("inf"), 5e-324])], "metric_id long, metric_name string, blob_id long, pos int, val double")
    for codec in ("raw", "gorilla", "chimp", "alp"):
        (r,) = S.column_bytes(points, codec).collect()
        assert (r.n, r.n_mismatch) == (6, 0)


def _named_points(spark, n, each):
    from seriesloom.model import points

    df = spark.range(n * each).selectExpr(f"concat('m', id % {n}) as name", "86400000000 * 5 + id * 7 as ts", "concat('v', id % 10) as val", "id")
    return points(df, "text", F.col("name"), F.col("ts"), F.col("val"), None, order=[F.col("id")])


def test_more_metrics_than_a_blob_holds_take_several(spark, monkeypatch):
    """They were MetricCountExceeded."""
    p = _named_points(spark, 20, 3)
    whole = S.encode_blobs(p, B.TextConfig(), names=True)
    assert whole.count() == 1
    monkeypatch.setattr(B, "MAX_COMPACT", 6)
    blobs = S.encode_blobs(p, B.TextConfig(), names=True)
    assert sorted(len(B.decode(r.data).metrics) for r in blobs.collect()) == [2, 6, 6, 6]
    cols = ["metric_name", "blob_id", "pos", "ts", "text"]
    assert sorted(map(tuple, S.decode_blobs(blobs).select(*cols).collect())) == sorted(map(tuple, p.withColumnRenamed("val", "text").select(*cols).collect()))


def test_a_blob_is_decoded_some_metrics_at_a_time():
    """All of its points came as one batch."""
    n = 40_000
    data = B.encode_numeric(7, [B.Metric(i, np.arange(n) * i, np.arange(n) / i, [str(i)] * n) for i in (1, 2, 3)], B.Config(B.DELTA_PACKED, B.CHIMP, tags=True, v2=True))
    batches = list(S._points_of(data, 5, True))
    assert [b.num_rows for b in batches] == [n, n, n]
    for i, b in enumerate(batches, 1):
        assert b.column(7).to_pylist() == (np.arange(n) * i).tolist() and b.column(8).to_pylist() == (np.arange(n) / i).tolist()
        assert set(b.column(10).to_pylist()) == {str(i)} and b.column(6).to_pylist() == list(range(n)) and set(b.column(1).to_pylist()) == {5}
