"""Relational operators: hand-written cases of sets, lookups, durations, ingest, regression."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import model
from seriesloom.codecs import blob as B
from seriesloom.errors import SeriesError
from seriesloom.functions import sizes
from seriesloom.functions.ids import _hashed_in_python, metric_id, unsigned_text
from seriesloom.operators import ingest, lookup, materialize, regression, resample, scan, sets, sizing, summary
from seriesloom.series import MixedSet, SeriesSet

HOUR = 3_600_000_000
MINUTE = 60_000_000


def points(spark, rows, kind="numeric"):
    """rows: (blob, ord, metric, pos, ts, val, tag)."""
    made = [(kind, b, b * HOUR, o, hash(m) % 1000 + 1 if isinstance(m, str) else m, m if isinstance(m, str) else None, p, t, v, g) for b, o, m, p, t, v, g in rows]
    return spark.createDataFrame(made, model.NUMERIC if kind == "numeric" else model.TEXT)


@pytest.fixture(scope="module")
def numeric(spark):
    rows = [(b, 0, "cpu", i, b * HOUR + i * MINUTE, 10.0 * b + i, f"t{i}") for b in (0, 1) for i in range(3)]
    rows += [(1, 0, "both", 0, HOUR, 1.0, "")]
    return points(spark, rows)


@pytest.fixture(scope="module")
def text(spark):
    rows = [(b, 0, "log", i, b * HOUR + i * MINUTE, f"v{b}{i}", "") for b in (2, 3) for i in range(4)]
    rows += [(2, 0, "both", i, 2 * HOUR + i, f"b{i}", "x") for i in range(3)]
    return points(spark, rows, "text")


def test_ids(spark):
    got = spark.createDataFrame([("cpu.usage",), ("memory.usage",), (None,)], "n string").select("n", metric_id(F.col("n")).alias("a"), _hashed_in_python(F.col("n")).alias("b"), unsigned_text(metric_id(F.col("n"))).alias("u")).collect()
    assert [(r.a, r.b) for r in got] == [(1823322468301511050,) * 2, (-1330468868358082636,) * 2, (None, None)]
    assert got[1].u == "17116275205351468980"


def test_duration_is_by_position(spark, numeric, text):
    assert SeriesSet(numeric).duration("cpu") == 62 * MINUTE
    assert SeriesSet(text).duration("log") == 63 * MINUTE
    back = points(spark, [(0, 0, "m", 0, 100, 1.0, ""), (0, 0, "m", 1, 50, 1.0, "")])
    assert SeriesSet(back).duration("m") == 0 and SeriesSet(back).duration("none") == 0


def test_access_paths_agree(numeric):
    s = SeriesSet(numeric)
    scanned = sorted((r.gidx, r.ts, r.val, r.tag) for r in s.all("cpu").collect())
    assert [g for g, *_ in scanned] == list(range(6))
    assert [tuple(x) for x in s.iterate("cpu")] == scanned
    assert [(g, r.ts, r.val, r.tag) for g, r in ((g, s.at("cpu", g)) for g in range(6))] == scanned
    arrays = materialize.exploded(s.materialize("cpu")).collect()
    assert sorted((r.gidx, r.ts, r.val, r.tag) for r in arrays) == scanned
    one = s.materialize("cpu").select(*[materialize.value_at(i) for i in (0, 5, 6, -1)]).first()
    assert tuple(one) == (0.0, 12.0, None, None)
    assert [r.val for r in scan.first_points(numeric, 4, "cpu").orderBy("gidx").collect()] == [v for _, _, v, _ in scanned[:4]]
    local = sorted((r.pos, r.val) for r in scan.scan(numeric, "cpu", 1).collect())
    assert local == [(0, 10.0), (1, 11.0), (2, 12.0)]


def test_missing_things_give_nothing(numeric):
    s = SeriesSet(numeric)
    assert s.all("no").count() == 0 and s.at("cpu", 6) is None and s.at("cpu", -1) is None and s.value_at("no", 0) is None
    assert not s.has("no") and s.length("no") == 0 and not s.has(123456) and s.blob(9).points.count() == 0 and s.blob(-1).points.count() == 0
    assert not s.for_each("no", lambda *a: True) and not s.for_each("cpu", None)
    with pytest.raises(SeriesError, match="EmptyBlobSet"):
        SeriesSet.of()
    with pytest.raises(SeriesError, match="EmptyBlobSet"):
        SeriesSet(numeric.limit(0)).time_range()


def test_for_each_stops(numeric):
    seen = []
    assert SeriesSet(numeric).for_each("cpu", lambda g, v: seen.append(v) or len(seen) < 4, "values")
    assert seen == [0.0, 1.0, 2.0, 10.0]


def test_blobs_of_one_start_are_ordered_by_blob_ord_and_never_merged(spark):
    p = points(spark, [(0, 1, "m", 0, 5, 2.0, ""), (0, 0, "m", 0, 5, 1.0, ""), (0, 0, "m", 1, 5, 1.5, "")])
    assert [(r.gidx, r.val) for r in SeriesSet(p).all("m").orderBy("gidx").collect()] == [(0, 1.0), (1, 1.5), (2, 2.0)]


def test_mixed_sets(numeric, text):
    s = MixedSet(SeriesSet(numeric), SeriesSet(text))
    assert s.timestamps("both").count() == 1 and s.timestamps("log").count() == 8  # text only where no numeric blob has it
    assert s.timestamp_at("both", 0) == HOUR and s.timestamp_at("both", 2) == 2 * HOUR + 2 and s.tag_at("both", 2) == "x" and s.tag_at("both", 0) == ""
    assert s.length("both") == 1 and s.duration("both") == 2 and s.length("none") == 0
    assert s.is_numeric("both") and s.is_text("both") and not s.is_text("cpu")
    assert {r.metric_name: (r.is_numeric, r.is_text) for r in sets.kinds(numeric, text).collect()} == {"cpu": (True, False), "both": (True, True), "log": (False, True)}
    assert s.numeric_at("both", 0).val == 1.0 and s.text_at("both", 1).val == "b1"


def test_summaries(numeric):
    s = SeriesSet(numeric)
    assert s.time_range() == (0, HOUR)  # the start of the last blob
    assert {(r.blob_id, r.n_metrics, r.n_points) for r in s.blobs().collect()} == {(0, 1, 3), (1, 2, 4)}
    assert summary.metric_count(numeric).first().n_metrics == 2
    assert lookup.resolve_names(numeric, ["cpu", "no"]).count() == 1
    empty = summary.statistics(numeric.limit(0)).first()
    assert tuple(empty) == (0.0,) * 5
    st = summary.statistics(numeric.where("metric_name = 'cpu'")).first()
    assert (st["min"], st["max"], st["mean"], st["median"]) == (0.0, 12.0, 6.0, 6.0) and math.isclose(st["stddev"], math.sqrt(sum((v - 6) ** 2 for v in (0, 1, 2, 10, 11, 12)) / 6))


def test_filters_reach_the_scan(spark, numeric, tmp_path):
    numeric.write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    plan = scan.set_scan(p, 77, "values")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric_id,77)" in plan
    assert "tag" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_filters_of_the_registered_queries_reach_parquet(spark):
    from seriesloom.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name in ("scan_metric", "scan_timestamps", "scan_values", "scan_tags", "blob_point_at", "set_scan_values", "set_scan_timestamps", "set_scan_tags", "point_at"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.split("\n") if "PushedFilters" in line]
        assert pushed and all("EqualTo(event_type," in line for line in pushed), name
        if name.startswith(("scan", "blob")):
            assert all("GreaterThanOrEqual(ts," in line and "LessThan(ts," in line for line in pushed), name


def test_names_and_ids_of_one_metric(spark):
    schema = "kind string, blob_id long, blob_start long, blob_ord int, metric_name string, pos int, ts long, val double, tag string"
    rows = [("numeric", 0, 0, 0, "cpu", k, k, float(k), "") for k in range(2)] + [("numeric", 1, 10, 0, None, 0, 10, 5.0, "")]
    p = spark.createDataFrame(rows, schema).withColumn("metric_id", metric_id(F.lit("cpu"))).select(*model.COLUMNS)
    assert [tuple(r)[1:] for r in summary.lengths(p).collect()] == [("cpu", 3)]
    assert [tuple(r)[1:] for r in summary.durations(p).collect()] == [("cpu", 10)]
    assert [(r.gidx, r.val, r.metric_name) for r in scan.set_scan(p, "cpu").orderBy("gidx").collect()] == [(0, 0.0, "cpu"), (1, 1.0, "cpu"), (2, 5.0, "cpu")]
    assert lookup.set_at(p, "cpu", 2).first().val == 5.0 and lookup.has_metric(p.where("metric_name is null"), "cpu")
    assert {(r.name, r.present) for r in lookup.has_metrics(p.where("blob_id = 1"), ["cpu", "no"]).collect()} == {("cpu", True), ("no", False)}
    # Two names of one id stay apart, and points without a name are then a third metric.
    q = p.unionByName(p.where("blob_id = 0").withColumn("metric_name", F.lit("other")).withColumn("val", F.col("val") + 100))
    assert {(r.metric_name, r.n) for r in summary.lengths(q).collect()} == {("cpu", 2), ("other", 2), (None, 1)}
    assert sorted((str(r.metric_name), r.gidx, r.val) for r in scan.set_scan(q).collect()) == [("None", 0, 5.0), ("cpu", 0, 0.0), ("cpu", 1, 1.0), ("other", 0, 100.0), ("other", 1, 101.0)]
    assert {(r.metric_name, r.val) for r in scan.first_points(p, 1).collect()} == {("cpu", 0.0)}


# ------------------------------------------------------------------------ ingest


def test_claims(spark):
    p = points(spark, [(0, 0, "a", i, i, 1.0, "") for i in range(3)] + [(0, 0, "c", 0, 0, 1.0, "")])
    claims = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (0, "d", 0)], "blob_id long, metric_name string, claimed int")
    out = {r.metric_name: r.code for r in ingest.claim_violations(p, claims, ["blob_id", "metric_name"]).collect()}
    assert out == {"a": "TooManyDataPoints", "b": "NoDataPointsAdded", "c": "NoMetricStarted", "d": "InvalidNumOfDataPoints"}
    with pytest.raises(SeriesError):
        ingest.require_none(ingest.claim_violations(p, claims, ["blob_id", "metric_name"]))
    ingest.require_none(ingest.claim_violations(p.limit(0), claims.limit(0), ["blob_id", "metric_name"]))


def test_identities(spark):
    m = spark.createDataFrame([(0, 0, None), (0, 5, None), (0, 5, None), (1, 1, ""), (1, 2, "x"), (2, 2, "x"), (2, 2, "x"), (3, 1, None), (3, 2, "n"), (4, 9, "fine")], "blob_id long, metric_id long, metric_name string")
    out = {(r.blob_id, r.metric_id, r.code) for r in ingest.identity_violations(m).collect()}
    assert out == {(0, 0, "InvalidMetricID"), (0, 5, "HashCollision"), (1, 1, "InvalidMetricName"), (2, 2, "InvalidMetricName"), (3, 1, "MixedIdentifierMode"), (3, 2, "MixedIdentifierMode")}
    p = spark.createDataFrame([(0, 7, "a"), (0, 7, "b"), (0, 8, "c")], "blob_id long, metric_id long, metric_name string")
    assert [(r.metric_id, r.names) for r in ingest.collisions(p).collect()] == [(7, ["a", "b"])]
    assert ingest.hash_mismatches(p).count() == 3


def test_arrays_and_rows(spark):
    df = spark.createDataFrame([("a", [1, 2], [1.0, 2.0], ["x"]), ("b", [], [], [])], "m string, t array<bigint>, v array<double>, g array<string>")
    assert [(r.m, r.pos, r.ts, r.val) for r in ingest.from_columns(df, "t", "v", keep=["m"]).collect()] == [("a", 0, 1, 1.0), ("a", 1, 2, 2.0)]
    with pytest.raises(Exception, match="DataPointCountMismatch"):
        ingest.from_columns(df, "t", "v", "g").collect()
    rows = ingest.from_rows(df.select(F.col("m")), F.lit(5), F.lit(1.5), None, name=F.col("m")).collect()
    assert rows[0].asDict() == {"name": "a", "ts": 5, "val": 1.5, "tag": ""}


def test_order_and_limits(spark, numeric, text):
    assert {r.metric_name: r.n_bad for r in ingest.monotonic_violations(numeric).collect()} == {"cpu": 0, "both": 0}
    p = points(spark, [(0, 0, "m", 0, 5, 1.0, ""), (0, 0, "m", 1, 5, 1.0, ""), (1, 0, "m", 0, 4, 1.0, ""), (1, 0, "m", 1, 9, 1.0, "")])
    assert ingest.monotonic_violations(p).first().n_bad == 2
    assert ingest.gaps(p).count() == 0
    long = spark.createDataFrame([("é" * 128, ""), ("e" * 255, ""), ("a", "t" * 256)], "val string, tag string")
    assert ingest.text_limit_violations(long).count() == 2


# ------------------------------------------------------------- sizes and regression


def test_varint_sizes_match_the_codec(spark):
    import numpy as np

    from seriesloom.codecs import bits, timestamps

    numbers = [0, 1, 127, 128, 16383, 16384, 2**35, 2**56 - 1, 2**56, 2**62, -1, -(2**62)]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(sizes.varint_bytes(F.col("n")).alias("b"), sizes.varint_bytes(sizes.zigzag(F.col("n"))).alias("z")).collect()
    assert [r.b for r in got] == [len(bits.put_varints(np.array([n]).astype(np.int64).view(np.uint64))) for n in numbers]
    assert [r.z for r in got] == [len(bits.put_varints(bits.zigzag(np.array([n])))) for n in numbers]
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 6, 7, 40):
        ts = np.cumsum(rng.integers(0, 10**7, n) ** 2) + 1_700_000_000_000_000
        p = spark.createDataFrame([(1, "m", 0, i, int(t)) for i, t in enumerate(ts)], "metric_id long, metric_name string, blob_id long, pos int, ts long")
        r = sizes.timestamp_bytes(p).first()
        assert (r.raw, r.delta, r.packed) == (8 * n, len(timestamps.encode_delta(ts)), len(timestamps.encode_packed(ts)))


def test_capacity_and_ratios(spark):
    assert sizes.max_points("raw", "raw") == 8191 and sizes.max_points() == 7281 and sizes.max_points(wide=True) == 2**32 - 1
    r = spark.range(1).select(sizes.compression_ratio(F.lit(200), F.lit(50)).alias("a"), sizes.space_savings(F.lit(200), F.lit(50)).alias("b"), sizes.compression_ratio(F.lit(0), F.lit(5)).alias("c")).first()
    assert tuple(r) == (0.25, 75.0, 0.0)


def test_published_raw_size(spark):
    from seriesloom.sources.generators import random_walk

    p = random_walk(spark)
    m = {r.label: r for r in sizing.encoding_matrix(p).collect()}
    assert round(m["raw-raw"].bpp, 3) == 16.081 and m["raw-raw"].ratio == 1.0 and len(m) == 24
    assert 8.0 < m["delta-gorilla"].bpp < 9.5 and m["delta-chimp"].bpp < m["delta-gorilla"].bpp


def test_ladder_and_chunks(spark, numeric):
    assert resample.ladder(0) == [] and resample.ladder(1) == [1] and resample.ladder(130) == [1, 2, 5, 10, 20, 50, 100, 130] and resample.ladder(110)[-1] == 100
    assert [r.ppm for r in resample.ladder_rows(spark, numeric).orderBy("ppm").collect()] == resample.ladder(resample.cap(numeric).first().cap)
    got = {(r.ppm, r.chunk): (r.n_metrics, r.n_points) for r in resample.chunk_sizes(numeric, [4]).collect()}
    assert got == {(4, 0): (2, 5), (4, 1): (1, 2)}
    assert sizing.measured(numeric, [1, 4], "raw", "raw").orderBy("ppm").first().bytes == 6 * 32 + 7 * 32
    assert sorted(r.val for r in resample.evenly(numeric, 3).collect()) == [0.0, 10.0, 12.0]
    assert [r.val for r in resample.evenly(numeric, 1).where("metric_name = 'cpu'").collect()] == [0.0]
    assert resample.normalized(numeric).count() == 2


def fit(spark, xs, ys, model_name):
    df = spark.createDataFrame(list(zip([float(x) for x in xs], [float(y) for y in ys])), "ppm double, bpp double")
    return regression.fits(df).where(F.col("model") == model_name).first()


def test_fits_recover_what_made_the_data(spark):
    xs = [1, 2, 5, 10, 20, 50]
    for name, f, want in [
        ("hyperbolic", lambda x: 9 + 23 / x, (9, 23)), ("logarithmic", lambda x: 20 - 1.5 * math.log(x), (20, -1.5)), ("power", lambda x: 25 * x**-0.3, (25, -0.3)),
        ("exponential", lambda x: 3 * math.exp(-0.05 * x), (3, -0.05)), ("polynomial", lambda x: 3 + 0.5 * x - 0.01 * x * x, (3, 0.5)),
    ]:
        r = fit(spark, xs, [f(x) for x in xs], name)
        assert math.isclose(r.a, want[0], rel_tol=1e-6) and math.isclose(r.b, want[1], rel_tol=1e-6) and math.isclose(r.r2, 1, rel_tol=1e-9) and r.rmse < 1e-6
    assert math.isclose(fit(spark, xs, [3 + 0.5 * x - 0.01 * x * x for x in xs], "polynomial").c, -0.01, rel_tol=1e-6)


def test_fit_edges(spark):
    two = fit(spark, [1, 2], [3, 5], "polynomial")
    assert (two.a, two.b, two.c) == (1.0, 2.0, 0.0)
    assert fit(spark, [1], [3], "power") is None
    assert fit(spark, [1, 2, 3], [4, 4, 4], "hyperbolic").r2 == 0.0
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 4.0), ("h", 1.0, 1.0)], "k string, ppm double, bpp double")
    assert {r.k for r in regression.fits(df, keys=["k"]).collect()} == {"g"}


def test_ranking_estimates_and_words(spark):
    xs = [1, 2, 5, 10, 20]
    df = spark.createDataFrame([(float(x), 9 + 23 / x) for x in xs], "ppm double, bpp double")
    best = regression.ranked(regression.fits(df)).where("rank = 1").first()
    assert best.model == "hyperbolic"
    r = spark.range(1).select(regression.estimate("Hyperbolic", [9, 23], F.lit(10)).alias("a"), regression.estimate("power", [1, 1], F.lit(0)).alias("b"), regression.quality(F.lit(0.96)).alias("q"), regression.formula(F.lit("power"), F.lit(2.0), F.lit(-0.5), F.lit(None).cast("double")).alias("f")).first()
    assert (r.a, r.b, r.q, r.f) == (11.3, math.inf, "very good", "BPP = 2.00 * PPM^-0.500")
    with pytest.raises(ValueError):
        regression.estimate("cubic", [1], F.lit(1))
    with pytest.raises(ValueError):
        regression.estimate("power", [1], F.lit(1))
    rec = regression.recommendations(df).first()
    assert (rec.min_acceptable, rec.optimal_start, rec.optimal_end, rec.diminishing_after) == (20.0, None, None, None)


def test_analysis_of_a_set_and_of_each_blob(spark):
    from seriesloom.operators.analysis import analyze, analyze_each
    from seriesloom.sources.generators import profile

    p = profile(spark, "decimal_gauge_2dp", 3, 60)
    whole = {r.rank: r for r in analyze(p, "raw", "raw").collect()}
    assert sorted(whole) == [1, 2, 3, 4, 5] and whole[1].model == "hyperbolic" and whole[1].formula.startswith("BPP = 16.")
    each = analyze_each(p, "raw", "raw").collect()
    assert {(r.rank, r.model) for r in each} == {(k, r.model) for k, r in whole.items()}
    assert analyze(p.limit(0)).count() == 0


def test_slots_give_the_same_positions(spark):
    """All points of a metric's blob were sorted by one task."""
    from seriesloom.model import DAY, points, ship_points

    df = spark.range(3000).selectExpr("concat('m', id % 2) as name", f"(id * 7919 % 400) * {DAY // 4} - {DAY * 9} as ts", "cast(id as double) as val", "id")
    made = [points(df, "numeric", F.col("name"), F.col("ts"), F.col("val"), None, 30 * DAY, [F.col("id")], slot_us=s) for s in (None, DAY, 7 * DAY + 1)]
    assert made[0].dtypes == made[1].dtypes
    rows = [sorted(map(tuple, p.select("metric_name", "blob_id", "pos", "ts", "val").collect())) for p in made]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 3000
    plan = ship_points(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert any("row_number" in line and "__slot" in line.split("[l_orderkey")[0] for line in plan.split("\n") if "Window" in line)


def test_sizes_of_all_chunk_lengths_from_one_pass(spark, monkeypatch):
    """Points were sent once for each length, and each chunk was encoded by itself."""
    from seriesloom.model import event_points
    from seriesloom.operators import sizing
    from seriesloom.operators.resample import LADDER, chunks

    p = event_points(spark, "/root/testdata/sf0.001").cache()
    for ppms in ([1, 2, 5, 10, 20, 50, 100, 150, 190], [1, 2, 5]):
        rows = chunks(p, ppms).select(F.col("ppm").cast("long"), "chunk", "metric_id", "metric_name", "chunk_pos", "ts", "val")
        columns = sizing.column_sizes(rows, ["ppm", "chunk"], B.DELTA, B.GORILLA)
        blobs = columns.groupBy("ppm", "chunk").agg(F.sum("n").alias("n"), (F.sum("bytes") + 32 + 16 * F.count(F.lit(1))).alias("bytes"))
        want = {(r.ppm, r.n, r.b) for r in blobs.groupBy("ppm").agg(F.sum("n").alias("n"), F.sum("bytes").alias("b")).collect()}
        assert {(r.ppm, r.n_points, r.bytes) for r in sizing.measured(p, ppms).collect()} == want
    sent = sizing.chunked_sizes(p.withColumn("own", F.lit(None).cast("long")), ["blob_id"], "pos", LADDER, "own")
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1 and sent.select("ppm").distinct().count() == len(LADDER)


def test_chunks_that_go_on_from_batch_to_batch():
    from seriesloom.operators.sizing import _Sizes

    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(1, 300))
        ts = np.cumsum(rng.integers(-5, 10 ** int(rng.integers(1, 12)), n)) + int(rng.integers(-10, 10**15))
        val = [rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.round(rng.random(n) * 100, 2), np.zeros(n)][trial % 4]
        for ppm in (1, 2, 7, 50, 1000):
            want = sum(len(B.timestamp_bytes(ts[a : a + ppm], B.DELTA)) + len(B.value_bytes(val[a : a + ppm], B.GORILLA)) for a in range(0, n, ppm))
            sizes, got, at = _Sizes(), 0, np.arange(n) % ppm
            cuts = [0, *np.unique(rng.integers(1, n + 1, 4)).tolist(), n]
            got = sum(sizes.add(at[a:b], ts[a:b], val[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
            assert got + sizes.end() == want
