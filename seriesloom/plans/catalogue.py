"""Queries over the test tables, one or more for each operator, and the same in SQL.

Columns have the same names on both sides; counts are longs and computed
doubles are rounded to six places, as sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.ids import metric_id
from seriesloom.functions.sizes import blob_bytes, shared_groups, timestamp_bytes, timestamp_steps
from seriesloom.model import event_points, ship_points, user_points
from seriesloom.operators import ingest, lookup, materialize, regression, resample, scan, sets, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Points of the events table: one metric per event type, one blob per day.
PTS = """pts AS (
    SELECT event_type AS metric, epoch_us(ts) // 86400000000 AS blob, epoch_us(ts) AS t, value AS val, coalesce(props, '') AS tag,
           row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts), event_id) - 1 AS pos
    FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
)"""
GPTS = PTS + """, gpts AS (
    SELECT *, row_number() OVER (PARTITION BY metric ORDER BY blob, pos) - 1 AS gidx, count(*) OVER (PARTITION BY metric) AS n FROM pts
)"""
TXT = """txt AS (
    SELECT CAST(user_id AS VARCHAR) AS metric, epoch_us(ts) // 86400000000 AS blob, epoch_us(ts) AS t, event_type AS val,
           row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts), event_id) - 1 AS pos
    FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL
), gtxt AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY blob, pos) - 1 AS gidx FROM txt)"""
#: Points of the lineitem table: one metric per return flag, one blob per 365 days, many points at one time.
SHIP = """ship AS (
    SELECT l_returnflag AS metric, epoch_us(l_shipdate) // 31536000000000 AS blob, epoch_us(l_shipdate) AS t, l_extendedprice AS val,
           row_number() OVER (PARTITION BY l_returnflag, epoch_us(l_shipdate) // 31536000000000
               ORDER BY epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linestatus) - 1 AS pos
    FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL
), gship AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY blob, pos) - 1 AS gidx FROM ship)"""
DAY19 = 19730  # 2024-01-08


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _six(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# -------------------------------------------------------------------------- scans


@query(f"WITH {PTS} SELECT pos, t AS ts, val, tag FROM pts WHERE metric = 'view' AND blob = {DAY19}")
def scan_metric(spark, d):
    return scan.scan(event_points(spark, d, metric="view", blob_id=DAY19), "view", DAY19).select(*_long("pos"), "ts", "val", "tag")


@query(f"WITH {PTS} SELECT pos, t AS ts FROM pts WHERE metric = 'view' AND blob = {DAY19}")
def scan_timestamps(spark, d):
    return scan.scan(event_points(spark, d, metric="view", blob_id=DAY19), "view", DAY19, "timestamps").select(*_long("pos"), "ts")


@query(f"WITH {PTS} SELECT pos, val FROM pts WHERE metric = 'view' AND blob = {DAY19}")
def scan_values(spark, d):
    return scan.scan(event_points(spark, d, metric="view", blob_id=DAY19), "view", DAY19, "values").select(*_long("pos"), "val")


@query(f"WITH {PTS} SELECT pos, tag FROM pts WHERE metric = 'view' AND blob = {DAY19}")
def scan_tags(spark, d):
    return scan.scan(event_points(spark, d, metric="view", blob_id=DAY19), "view", DAY19, "tags").select(*_long("pos"), "tag")


@query(f"WITH {GPTS} SELECT metric, gidx, t AS ts, val, tag FROM gpts")
def set_scan_global_index(spark, d):
    return scan.set_scan(event_points(spark, d)).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "val", "tag")


@query(f"WITH {GPTS} SELECT gidx, val FROM gpts WHERE metric = 'click'")
def set_scan_values(spark, d):
    return scan.set_scan(event_points(spark, d, metric="click"), "click", "values").select(*_long("gidx"), "val")


@query(f"WITH {GPTS} SELECT gidx, t AS ts FROM gpts WHERE metric = 'click'")
def set_scan_timestamps(spark, d):
    return scan.set_scan(event_points(spark, d, metric="click"), "click", "timestamps").select(*_long("gidx"), "ts")


@query(f"WITH {GPTS} SELECT gidx, tag FROM gpts WHERE metric = 'click'")
def set_scan_tags(spark, d):
    return scan.set_scan(event_points(spark, d, metric="click"), "click", "tags").select(*_long("gidx"), "tag")


@query(f"WITH {GPTS} SELECT metric, gidx, val FROM gpts WHERE gidx < 10")
def set_scan_first_n(spark, d):
    return scan.first_points(event_points(spark, d), 10).select(F.col("metric_name").alias("metric"), *_long("gidx"), "val")


@query(f"WITH {SHIP} SELECT metric, gidx, t AS ts, val FROM gship")
def tied_series_scan(spark, d):
    return scan.set_scan(ship_points(spark, d)).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "val")


# ------------------------------------------------------------------------ lookups


@query(f"WITH {GPTS} SELECT metric, gidx, val FROM gpts WHERE gidx IN (0, 7, 1000000) OR gidx = -1")
def value_at(spark, d):
    return lookup.at_indexes(event_points(spark, d), [0, 7, 1_000_000, -1]).select(F.col("metric_name").alias("metric"), *_long("gidx"), "val")


@query(f"WITH {GPTS} SELECT metric, gidx, t AS ts FROM gpts WHERE gidx IN (0, 7, 1000000)")
def timestamp_at(spark, d):
    return lookup.at_indexes(event_points(spark, d), [0, 7, 1_000_000]).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts")


@query(f"WITH {GPTS} SELECT metric, gidx, tag FROM gpts WHERE gidx IN (0, 7, 1000000)")
def tag_at(spark, d):
    return lookup.at_indexes(event_points(spark, d), [0, 7, 1_000_000]).select(F.col("metric_name").alias("metric"), *_long("gidx"), "tag")


@query(f"WITH {GPTS} SELECT t AS ts, val, tag FROM gpts WHERE metric = 'purchase' AND gidx = 99")
def point_at(spark, d):
    return lookup.set_at(event_points(spark, d, metric="purchase"), "purchase", 99)


@query(f"WITH {PTS} SELECT t AS ts, val, tag FROM pts WHERE metric = 'purchase' AND blob = {DAY19} AND pos = 3")
def blob_point_at(spark, d):
    return lookup.at(event_points(spark, d, metric="purchase", blob_id=DAY19), "purchase", DAY19, 3)


@query(f"WITH {PTS} SELECT name, EXISTS (SELECT 1 FROM pts WHERE metric = name) AS present FROM (VALUES ('view'), ('error'), ('nothing')) AS v(name)")
def has_metric(spark, d):
    return lookup.has_metrics(event_points(spark, d), ["view", "error", "nothing"])


@query(f"WITH {PTS} SELECT DISTINCT blob, metric FROM pts")
def metric_names_per_blob(spark, d):
    return lookup.metric_names(event_points(spark, d), per_blob=True).select(F.col("blob_id").alias("blob"), F.col("metric_name").alias("metric"))


# ---------------------------------------------------------------------- summaries


@query(f"WITH {PTS} SELECT blob, metric, count(*) AS n FROM pts GROUP BY ALL")
def blob_metric_len(spark, d):
    return summary.blob_lengths(event_points(spark, d)).select(F.col("blob_id").alias("blob"), F.col("metric_name").alias("metric"), "n")


@query(f"WITH {PTS} SELECT metric, count(*) AS n FROM pts GROUP BY ALL")
def metric_len(spark, d):
    return summary.lengths(event_points(spark, d)).select(F.col("metric_name").alias("metric"), "n")


@query(f"WITH {PTS} SELECT blob, count(DISTINCT metric) AS n_metrics FROM pts GROUP BY ALL")
def metric_count(spark, d):
    return summary.metric_count(event_points(spark, d), per_blob=True).select(F.col("blob_id").alias("blob"), "n_metrics")


@query(f"WITH {GPTS} SELECT metric, greatest(0, arg_max(t, gidx) - arg_min(t, gidx)) AS duration_us FROM gpts GROUP BY metric")
def metric_duration(spark, d):
    return summary.durations(event_points(spark, d)).select(F.col("metric_name").alias("metric"), "duration_us")


@query(f"WITH {PTS} SELECT min(blob) * 86400000000 AS start_us, max(blob) * 86400000000 AS end_us FROM pts")
def set_time_range(spark, d):
    return summary.time_range(event_points(spark, d))


@query(
    f"""WITH {PTS} SELECT metric, round(min(val), 6) AS min, round(max(val), 6) AS max, round(avg(val), 6) AS mean, round(median(val), 6) AS median,
    round(stddev_pop(val), 6) AS stddev FROM pts GROUP BY metric"""
)
def metric_stats(spark, d):
    s = summary.statistics(event_points(spark, d), keys=["metric_name"])
    return s.select(F.col("metric_name").alias("metric"), *[_six(c) for c in ("min", "max", "mean", "median", "stddev")])


@query(f"WITH {PTS} SELECT metric, round(sum(val), 4) AS total FROM pts GROUP BY metric")
def scan_sum(spark, d):
    return summary.value_sums(event_points(spark, d)).select(F.col("metric_name").alias("metric"), F.round("total", 4).alias("total"))


@query(f"WITH {PTS} SELECT blob, count(DISTINCT metric) AS n_metrics, count(*) AS n_points, max(tag <> '') AS has_tag, true AS has_names FROM pts GROUP BY blob")
def blob_metadata(spark, d):
    return summary.blobs(event_points(spark, d)).select(F.col("blob_id").alias("blob"), "n_metrics", "n_points", "has_tag", "has_names")


@query(f"WITH {PTS} SELECT metric, pos, t AS ts, val FROM pts WHERE blob = (SELECT DISTINCT blob FROM pts ORDER BY blob LIMIT 1 OFFSET 2)")
def blob_at(spark, d):
    return summary.blob_at(event_points(spark, d), 2).select(F.col("metric_name").alias("metric"), *_long("pos"), "ts", "val")


def _half_named(spark, d):
    """All events; blobs of even days are keyed by id and have no names."""
    p = event_points(spark, d)
    return p.withColumn("metric_name", F.when(F.col("blob_id") % 2 == 1, F.col("metric_name")))


@query(f"WITH {GPTS} SELECT metric, count(*) AS n, greatest(0, arg_max(t, gidx) - arg_min(t, gidx)) AS duration_us, round(sum(val), 4) AS total FROM gpts GROUP BY metric")
def half_named_summaries(spark, d):
    p = _half_named(spark, d)
    n, span, total = summary.lengths(p), summary.durations(p).drop("metric_name"), summary.value_sums(p).drop("metric_name")
    return n.join(span, "metric_id").join(total, "metric_id").select(F.col("metric_name").alias("metric"), "n", "duration_us", F.round("total", 4).alias("total"))


@query(f"WITH {GPTS} SELECT metric, gidx, t AS ts, val FROM gpts WHERE metric = 'click'")
def half_named_scan(spark, d):
    return scan.set_scan(_half_named(spark, d), "click").select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "val")


@query(f"WITH {GPTS} SELECT t AS ts, val, tag FROM gpts WHERE metric = 'purchase' AND gidx = 99")
def half_named_point_at(spark, d):
    return lookup.set_at(_half_named(spark, d), "purchase", 99)


@query(f"WITH {PTS} SELECT blob, metric, count(*) AS n FROM pts GROUP BY ALL")
def half_named_blob_lengths(spark, d):
    return summary.blob_lengths(_half_named(spark, d)).select(F.col("blob_id").alias("blob"), F.col("metric_name").alias("metric"), "n")


# ----------------------------------------------------------------- materialization


@query(f"WITH {GPTS} SELECT metric, gidx, t AS ts, val, tag FROM gpts")
def materialize_roundtrip(spark, d):
    out = materialize.exploded(materialize.materialize(event_points(spark, d)))
    return out.select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "val", "tag")


@query(
    f"""WITH {GPTS} SELECT metric, max(n) AS n, arg_min(t, gidx) AS first_ts, arg_max(t, gidx) AS last_ts, max(CASE WHEN gidx = 5 THEN val END) AS v5,
    CAST(NULL AS DOUBLE) AS missing, max(CASE WHEN gidx = 5 THEN tag END) AS t5 FROM gpts GROUP BY metric"""
)
def materialized_access(spark, d):
    m = materialize.materialize(event_points(spark, d))
    return m.select(F.col("metric_name").alias("metric"), *_long("n"), "first_ts", "last_ts", materialize.value_at(5).alias("v5"), materialize.value_at(-1).alias("missing"), materialize.tag_at(5).alias("t5"))


# --------------------------------------------------------------- text and mixed sets


@query(f"WITH {TXT} SELECT metric, gidx, t AS ts, val FROM gtxt")
def text_scan(spark, d):
    return scan.set_scan(user_points(spark, d)).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "val")


@query(f"WITH {TXT} SELECT metric, count(*) AS n FROM txt GROUP BY metric")
def text_len(spark, d):
    return summary.lengths(user_points(spark, d)).select(F.col("metric_name").alias("metric"), "n")


@query(f"WITH {TXT} SELECT metric, gidx, t AS ts, val FROM gtxt WHERE gidx IN (0, 3)")
def text_at(spark, d):
    return lookup.at_indexes(user_points(spark, d), [0, 3]).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "val")


def _mixed(spark, d):
    """Both sides from all events, under one set of names: a numeric metric for each event type, a text metric for each event type or user, by the half of the minute."""
    from seriesloom.model import micros, points, table

    e = table(spark, d, "events")
    name = F.when(F.second("ts") < 30, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    text = points(e, "text", name, micros(F.col("ts")), F.col("event_type"), None, order=[F.col("event_id")])
    return event_points(spark, d), text


MIX = (
    PTS
    + """, num AS (SELECT * FROM pts), gnum AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY blob, pos) - 1 AS gidx FROM num), txt AS (
    SELECT metric, blob, t, val, row_number() OVER (PARTITION BY metric, blob ORDER BY t, event_id) - 1 AS pos
    FROM (
        SELECT CASE WHEN second(ts) < 30 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS metric, epoch_us(ts) // 86400000000 AS blob, epoch_us(ts) AS t, event_type AS val, event_id
        FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL
    )
), gtxt AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY blob, pos) - 1 AS gidx FROM txt)"""
)


@query(f"WITH {MIX} SELECT metric, gidx, t AS ts FROM gnum UNION ALL SELECT metric, gidx, t FROM gtxt WHERE metric NOT IN (SELECT metric FROM num)")
def mixed_timestamps(spark, d):
    return sets.timestamps(*_mixed(spark, d)).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts")


@query(f"WITH {MIX} SELECT metric, gidx, tag FROM gnum UNION ALL SELECT metric, gidx, '' FROM gtxt WHERE metric NOT IN (SELECT metric FROM num)")
def mixed_tags(spark, d):
    return sets.tags(*_mixed(spark, d)).select(F.col("metric_name").alias("metric"), *_long("gidx"), "tag")


@query(
    f"""WITH {MIX} SELECT metric, gidx, t AS ts, tag FROM gnum WHERE gidx IN (0, 20)
    UNION ALL SELECT metric, gidx, t, '' FROM gtxt WHERE gidx IN (0, 20) AND NOT EXISTS (SELECT 1 FROM gnum WHERE gnum.metric = gtxt.metric AND gnum.gidx = gtxt.gidx)"""
)
def mixed_lookup(spark, d):
    return sets.lookup(*_mixed(spark, d), [0, 20]).select(F.col("metric_name").alias("metric"), *_long("gidx"), "ts", "tag")


@query(
    f"""WITH {MIX}, n AS (SELECT metric, count(*) AS k FROM num GROUP BY ALL), t AS (SELECT metric, count(*) AS k FROM txt GROUP BY ALL)
    SELECT coalesce(n.metric, t.metric) AS metric, coalesce(nullif(n.k, 0), t.k, 0) AS n FROM n FULL JOIN t ON n.metric = t.metric"""
)
def mixed_len(spark, d):
    return sets.mixed_lengths(*_mixed(spark, d)).select(F.col("metric_name").alias("metric"), "n")


@query(
    f"""WITH {MIX}, n AS (SELECT metric, greatest(0, arg_max(t, gidx) - arg_min(t, gidx)) AS k FROM gnum GROUP BY metric),
    t AS (SELECT metric, greatest(0, arg_max(t, gidx) - arg_min(t, gidx)) AS k FROM gtxt GROUP BY metric)
    SELECT coalesce(n.metric, t.metric) AS metric, coalesce(nullif(n.k, 0), t.k, 0) AS duration_us FROM n FULL JOIN t ON n.metric = t.metric"""
)
def mixed_duration(spark, d):
    return sets.mixed_durations(*_mixed(spark, d)).select(F.col("metric_name").alias("metric"), "duration_us")


@query(f"WITH {MIX} SELECT metric, metric IN (SELECT metric FROM num) AS is_numeric, metric IN (SELECT metric FROM txt) AS is_text FROM (SELECT metric FROM num UNION SELECT metric FROM txt)")
def mixed_type(spark, d):
    return sets.kinds(*_mixed(spark, d)).select(F.col("metric_name").alias("metric"), "is_numeric", "is_text")


# ------------------------------------------------------------- timestamps and sizes

STEPS = PTS + """, s AS (SELECT *, t - lag(t) OVER (PARTITION BY metric, blob ORDER BY pos) AS d FROM pts),
    steps AS (SELECT *, d - lag(d) OVER (PARTITION BY metric, blob ORDER BY pos) AS dd FROM s)"""


def _sql_len(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {1 << (7 * k)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


def _sql_zigzag(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN -2 * {x} - 1 ELSE 2 * {x} END)"


def _sql_group(u: str) -> str:
    return f"CASE WHEN {u} < 256 THEN 1 WHEN {u} < 65536 THEN 2 WHEN {u} < 4294967296 THEN 4 ELSE 8 END"


_HEAD = f"WHEN d IS NULL THEN {_sql_len('t')} WHEN dd IS NULL THEN {_sql_len(_sql_zigzag('d'))}"
TS_BYTES = STEPS + f""", tsb AS (
    SELECT metric, blob, count(*) AS n, count(*) * 8 AS raw, CAST(sum(CASE {_HEAD} ELSE {_sql_len(_sql_zigzag('dd'))} END) AS BIGINT) AS delta,
           CAST(sum(CASE {_HEAD} ELSE {_sql_group(_sql_zigzag('dd'))} END) + greatest(0, (count(*) + 1) // 4) AS BIGINT) AS packed
    FROM steps GROUP BY metric, blob
)"""


@query(f"WITH {STEPS} SELECT metric, blob, pos, coalesce(d, 0) AS d, coalesce(dd, 0) AS dd FROM steps")
def ts_delta_of_delta(spark, d):
    return timestamp_steps(event_points(spark, d)).select(F.col("metric_name").alias("metric"), F.col("blob_id").alias("blob"), *_long("pos"), F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("dd", F.lit(0)).alias("dd"))


@query(f"WITH {TS_BYTES} SELECT metric, blob, n, raw, delta, packed FROM tsb")
def timestamp_column_bytes(spark, d):
    return timestamp_bytes(event_points(spark, d)).select(F.col("metric_name").alias("metric"), F.col("blob_id").alias("blob"), *_long("n", "raw", "delta", "packed"))


@query(f"WITH {TS_BYTES} SELECT blob, CAST(32 + 16 * count(*) + sum(raw + 8 * n) AS BIGINT) AS bytes, round((32 + 16 * count(*) + sum(raw + 8 * n)) / sum(n), 6) AS bpp FROM tsb GROUP BY blob")
def blob_size_raw(spark, d):
    columns = timestamp_bytes(event_points(spark, d)).withColumn("val_bytes", F.col("n") * 8)
    return blob_bytes(columns).select(F.col("blob_id").alias("blob"), *_long("bytes"), _six("bpp"))


@query(f"WITH {TS_BYTES} SELECT blob, CAST(32 + 16 * count(*) + sum(delta + 8 * n) AS BIGINT) AS bytes, round((32 + 16 * count(*) + sum(delta + 8 * n)) / sum(n), 6) AS bpp FROM tsb GROUP BY blob")
def blob_size_delta(spark, d):
    columns = timestamp_bytes(event_points(spark, d)).withColumn("val_bytes", F.col("n") * 8)
    return blob_bytes(columns, "delta").select(F.col("blob_id").alias("blob"), *_long("bytes"), _six("bpp"))


@query(
    """WITH pt AS (
        SELECT p_brand AS metric, p_partkey // 50 AS blob, p_size AS t, row_number() OVER (PARTITION BY p_brand, p_partkey // 50 ORDER BY p_partkey) - 1 AS pos FROM part
    ), seqs AS (SELECT blob, metric, list(t ORDER BY pos) AS seq FROM pt GROUP BY ALL)
    SELECT blob, CAST(len(seq) AS BIGINT) AS seq_n, count(*) AS members FROM seqs GROUP BY blob, seq HAVING count(*) > 1"""
)
def shared_timestamp_groups(spark, d):
    from seriesloom.model import table

    w = Window.partitionBy("metric_name", "blob_id").orderBy("p_partkey")
    pts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("metric_name"), F.floor(F.col("p_partkey") / 50).alias("blob_id"), F.col("p_size").cast("long").alias("ts"))
    pts = pts.withColumns({"pos": F.row_number().over(w) - 1, "metric_id": metric_id(F.col("metric_name"))})
    return shared_groups(pts).select(F.col("blob_id").alias("blob"), *_long("seq_n", "members"))


@query(f"WITH {GPTS}, g AS (SELECT *, t <= lag(t) OVER (PARTITION BY metric ORDER BY blob, pos) AS bad FROM gpts) SELECT metric, count(*) FILTER (bad) AS n_bad FROM g GROUP BY metric")
def monotonic_violations(spark, d):
    return ingest.monotonic_violations(event_points(spark, d)).select(F.col("metric_name").alias("metric"), *_long("n_bad"))


@query(f"WITH {SHIP}, g AS (SELECT *, t <= lag(t) OVER (PARTITION BY metric ORDER BY blob, pos) AS bad FROM gship) SELECT metric, count(*) FILTER (bad) AS n_bad FROM g GROUP BY metric")
def monotonic_violations_tied(spark, d):
    return ingest.monotonic_violations(ship_points(spark, d)).select(F.col("metric_name").alias("metric"), *_long("n_bad"))


@query(
    """SELECT user_id % 7 AS blob, event_type AS metric, count(*) AS n, 20 AS claimed,
       CASE WHEN count(*) > 20 THEN 'TooManyDataPoints' ELSE 'DataPointCountMismatch' END AS code
       FROM events GROUP BY ALL HAVING count(*) <> 20"""
)
def claim_violations(spark, d):
    from seriesloom.model import table

    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("blob_id"), F.col("event_type").alias("metric_name"))
    claims = e.distinct().withColumn("claimed", F.lit(20).cast("long"))
    out = ingest.claim_violations(e, claims, ["blob_id", "metric_name"])
    return out.select(F.col("blob_id").alias("blob"), F.col("metric_name").alias("metric"), *_long("n"), F.col("claimed").cast("int").alias("claimed"), "code")


@query("""SELECT 'ValueTooLong' AS code, count(*) AS n FROM documents WHERE strlen(text) > 255""")
def text_limit_violations(spark, d):
    from seriesloom.model import table

    return ingest.text_limit_violations(table(spark, d, "documents").select(F.col("text").alias("val"), F.lit("").alias("tag"))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- chunks and models

LADDER = "(VALUES (1), (2), (5), (10), (20), (50), (100), (150), (200), (500), (1000), (2000), (5000)) AS l(ppm)"
CHUNKS = GPTS + f""", chunks AS (
    SELECT CAST(ppm AS BIGINT) AS ppm, gidx // ppm AS chunk, count(DISTINCT metric) AS n_metrics, count(*) AS n_points FROM gpts, {LADDER} GROUP BY ALL
), bpp AS (SELECT ppm, CAST(sum(32 + 16 * n_metrics + 16 * n_points) AS DOUBLE) / sum(n_points) AS bpp FROM chunks GROUP BY ppm)"""


def measured_raw(spark, d) -> DataFrame:
    """(ppm, bpp) of the events' points under raw encoding, re-chunked."""
    c = resample.chunk_sizes(event_points(spark, d), resample.LADDER)
    size = F.sum(32 + 16 * F.col("n_metrics") + 16 * F.col("n_points"))
    return c.groupBy("ppm").agg((size / F.sum("n_points")).alias("bpp"))


@query(f"WITH {CHUNKS} SELECT ppm, chunk, n_metrics, n_points, 32 + 16 * n_metrics + 16 * n_points AS bytes FROM chunks")
def chunk_sizes(spark, d):
    c = resample.chunk_sizes(event_points(spark, d), resample.LADDER)
    return c.withColumn("bytes", 32 + 16 * F.col("n_metrics") + 16 * F.col("n_points")).select(*_long("ppm", "chunk", "n_metrics", "n_points", "bytes"))


@query(
    f"""WITH {GPTS}, n AS (SELECT count(*) AS n FROM gpts GROUP BY metric),
    c AS (SELECT CASE WHEN floor(avg(n)) > 0 THEN least(floor(avg(n)), quantile_disc(n, 0.9)) ELSE greatest(quantile_disc(n, 0.9), 1) END AS cap FROM n),
    below AS (SELECT ppm, cap FROM {LADDER}, c WHERE ppm <= cap)
    SELECT CAST(ppm AS BIGINT) AS ppm FROM below UNION ALL SELECT CAST(cap AS BIGINT) FROM c WHERE cap > 1.2 * coalesce((SELECT max(ppm) FROM below), 0)"""
)
def ppm_ladder(spark, d):
    return resample.ladder_rows(spark, event_points(spark, d)).select(*_long("ppm"))


@query(f"WITH {GPTS} SELECT metric, gidx AS i, t AS ts, val FROM gpts WHERE gidx < 25")
def resample_first(spark, d):
    return resample.first_n(event_points(spark, d), 25).select(F.col("metric_name").alias("metric"), *_long("i"), "ts", "val")


@query(f"WITH {GPTS} SELECT metric, i, t AS ts, val FROM gpts JOIN (SELECT unnest(range(10)) AS i) AS r ON gidx = least(n - 1, round(i * ((n - 1) / 9.0))) WHERE n >= 10")
def resample_evenly(spark, d):
    return resample.evenly(event_points(spark, d), 10).select(F.col("metric_name").alias("metric"), *_long("i"), "ts", "val")


@query(f"WITH {GPTS} SELECT metric, gidx, val FROM gpts WHERE gidx < (SELECT min(n) FROM gpts)")
def resample_normalized(spark, d):
    return scan.with_global_index(resample.normalized(event_points(spark, d))).select(F.col("metric_name").alias("metric"), *_long("gidx"), "val")


def _fit(spark, d, model):
    f = regression.fits(measured_raw(spark, d)).where(F.col("model") == model)
    return f.select(*[_six(c) for c in (("a", "b", "c") if model == "polynomial" else ("a", "b"))], _six("r2"), _six("rmse"))


def _fit_sql(a: str, b: str, value: str) -> str:
    return f"""WITH {CHUNKS}, k AS (SELECT {a} AS a, {b} AS b, avg(bpp) AS m FROM bpp),
    e AS (SELECT a, b, bpp, m, {value} AS p FROM (SELECT *, CAST(ppm AS DOUBLE) AS x FROM bpp), k)
    SELECT round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, round(1 - sum((bpp - p) ** 2) / sum((bpp - m) ** 2), 6) AS r2, round(sqrt(avg((bpp - p) ** 2)), 6) AS rmse FROM e"""


@query(_fit_sql("regr_intercept(bpp, 1.0 / ppm)", "regr_slope(bpp, 1.0 / ppm)", "a + b / x"))
def fit_hyperbolic(spark, d):
    return _fit(spark, d, "hyperbolic")


@query(_fit_sql("regr_intercept(bpp, ln(ppm))", "regr_slope(bpp, ln(ppm))", "a + b * ln(x)"))
def fit_logarithmic(spark, d):
    return _fit(spark, d, "logarithmic")


@query(_fit_sql("exp(regr_intercept(ln(bpp), ln(ppm)))", "regr_slope(ln(bpp), ln(ppm))", "a * x ** b"))
def fit_power(spark, d):
    return _fit(spark, d, "power")


@query(_fit_sql("exp(regr_intercept(ln(bpp), ppm))", "regr_slope(ln(bpp), ppm)", "a * exp(b * x)"))
def fit_exponential(spark, d):
    return _fit(spark, d, "exponential")


QUADRATIC = CHUNKS + """, m AS (
    SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(bpp) AS t0, sum(x * bpp) AS t1, sum(x * x * bpp) AS t2, avg(bpp) AS mean
    FROM (SELECT CAST(ppm AS DOUBLE) AS x, bpp FROM bpp)
), det AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS de FROM m),
k AS (
    SELECT mean, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / de AS a,
           (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / de AS b,
           (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / de AS c
    FROM det
)"""


@query(
    f"""WITH {QUADRATIC}, e AS (SELECT a, b, c, bpp, mean, a + b * ppm + c * ppm * ppm AS p FROM bpp, k)
    SELECT round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, round(any_value(c), 6) AS c, round(1 - sum((bpp - p) ** 2) / sum((bpp - mean) ** 2), 6) AS r2, round(sqrt(avg((bpp - p) ** 2)), 6) AS rmse FROM e"""
)
def fit_quadratic(spark, d):
    return _fit(spark, d, "polynomial")


def _r2_sql(model: str, ordinal: int, a: str, b: str, value: str) -> str:
    return f"""SELECT '{model}' AS model, {ordinal} AS o, 1 - sum((bpp - p) ** 2) / sum((bpp - m) ** 2) AS r2 FROM (
        SELECT bpp, m, {value} AS p FROM (SELECT *, CAST(ppm AS DOUBLE) AS x FROM bpp), (SELECT {a} AS a, {b} AS b, avg(bpp) AS m FROM bpp))"""


_SHAPES = [
    ("hyperbolic", "regr_intercept(bpp, 1.0 / ppm)", "regr_slope(bpp, 1.0 / ppm)", "a + b / x"),
    ("logarithmic", "regr_intercept(bpp, ln(ppm))", "regr_slope(bpp, ln(ppm))", "a + b * ln(x)"),
    ("power", "exp(regr_intercept(ln(bpp), ln(ppm)))", "regr_slope(ln(bpp), ln(ppm))", "a * x ** b"),
    ("exponential", "exp(regr_intercept(ln(bpp), ppm))", "regr_slope(ln(bpp), ppm)", "a * exp(b * x)"),
]


@query(
    f"WITH {QUADRATIC}, r AS ("
    + " UNION ALL ".join(_r2_sql(m, i, a, b, v) for i, (m, a, b, v) in enumerate(_SHAPES))
    + " UNION ALL SELECT 'polynomial', 4, 1 - sum((bpp - p) ** 2) / sum((bpp - mean) ** 2) FROM (SELECT bpp, mean, a + b * ppm + c * ppm * ppm AS p FROM bpp, k)"
    + """) SELECT model, round(r2, 6) AS r2, CAST(row_number() OVER (ORDER BY r2 DESC, o) AS BIGINT) AS rank,
    CASE WHEN r2 >= 0.98 THEN 'excellent' WHEN r2 >= 0.95 THEN 'very good' WHEN r2 >= 0.90 THEN 'good' WHEN r2 >= 0.80 THEN 'moderate' ELSE 'poor' END AS quality FROM r"""
)
def model_ranking(spark, d):
    r = regression.ranked(regression.fits(measured_raw(spark, d)))
    return r.select("model", _six("r2"), *_long("rank"), regression.quality(F.col("r2")).alias("quality"))


@query(
    f"""SELECT CAST(ppm AS BIGINT) AS ppm, round(9.0 + 23.0 / ppm, 6) AS hyperbolic, round(20.0 - 1.5 * ln(ppm), 6) AS logarithmic, round(25.0 * ppm ** -0.1, 6) AS power FROM {LADDER}"""
)
def estimate_bpp(spark, d):
    x = spark.createDataFrame([(p,) for p in resample.LADDER], "ppm long")
    e = lambda m, c: F.round(regression.estimate(m, c, F.col("ppm")), 6).alias(m)
    return x.select("ppm", e("hyperbolic", [9.0, 23.0]), e("logarithmic", [20.0, -1.5]), e("power", [25.0, -0.1]))


@query(
    f"""WITH {CHUNKS}, o AS (SELECT *, lead(bpp) OVER (ORDER BY ppm) AS nx, row_number() OVER (ORDER BY ppm DESC) AS back, count(*) OVER () AS k FROM bpp)
    SELECT coalesce(min(ppm) FILTER (bpp < 17.5), 0) AS min_acceptable, coalesce(min(ppm) FILTER (bpp < 16.5), 0) AS optimal_start, coalesce(max(ppm) FILTER (bpp < 16.1), 0) AS optimal_end,
           coalesce(max(ppm) FILTER (back = 2 AND k > 3 AND bpp - nx < 0.1), 0) AS diminishing_after FROM o"""
)
def size_recommendations(spark, d):
    r = regression.recommendations(measured_raw(spark, d), limits=(17.5, 16.5, 16.1))  # limits that fit raw encoding
    return r.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("min_acceptable", "optimal_start", "optimal_end", "diminishing_after")])


# ---------------------------------------------------- ids, codecs, blobs and streams


@query()
def metric_id_hash(spark, d):
    from seriesloom.model import table

    return table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("id", metric_id(F.col("name")))


def _codec(codec: str):
    def run(spark, d):
        from seriesloom.sources.blobs import column_bytes

        return column_bytes(event_points(spark, d), codec).select(F.col("metric_name").alias("metric"), F.col("blob_id").alias("blob"), "n", "bytes", "n_mismatch")

    run.__name__ = f"codec_roundtrip_{codec}"
    return run


for _name in ("gorilla", "chimp", "alp"):
    query()(_codec(_name))
query(f"WITH {PTS} SELECT metric, blob, count(*) AS n, count(*) * 8 AS bytes, CAST(0 AS BIGINT) AS n_mismatch FROM pts GROUP BY ALL")(_codec("raw"))


@query(f"WITH {PTS} SELECT metric, blob, pos, t AS ts, val, tag FROM pts")
def blob_roundtrip(spark, d):
    """Points to blobs of bytes, names kept, and back."""
    from seriesloom.codecs.blob import DELTA_PACKED, Config
    from seriesloom.codecs.blob import CHIMP as CHIMP_ID
    from seriesloom.sources.blobs import decode_blobs, encode_blobs

    p = event_points(spark, d)
    back = decode_blobs(encode_blobs(p, Config(DELTA_PACKED, CHIMP_ID, tags=True, shared=True)))
    names = p.select("metric_id", "metric_name").distinct()
    out = back.drop("metric_name").join(names, "metric_id")
    return out.select(F.col("metric_name").alias("metric"), F.col("blob_id").alias("blob"), *_long("pos"), "ts", "val", "tag")


@query(f"WITH {TXT} SELECT metric, blob, pos, t AS ts, val FROM txt")
def text_blob_roundtrip(spark, d):
    from seriesloom.codecs.blob import TextConfig
    from seriesloom.sources.blobs import decode_blobs, encode_blobs

    back = decode_blobs(encode_blobs(user_points(spark, d), TextConfig(), names=True))
    return back.select(F.col("metric_name").alias("metric"), F.col("blob_id").alias("blob"), *_long("pos"), "ts", F.col("text").alias("val"))


@query(f"WITH {TS_BYTES} SELECT blob, 'numeric' AS kind, blob * 86400000000 AS blob_start, count(*) AS n_metrics, CAST(sum(n) AS BIGINT) AS n_points, CAST(32 + 16 * count(*) + sum(delta + 8 * n) AS BIGINT) AS n_bytes FROM tsb GROUP BY blob")
def blob_headers(spark, d):
    """Headers of encoded blobs; their sizes are what the size functions say."""
    from seriesloom.codecs.blob import DELTA, RAW, Config
    from seriesloom.sources.blobs import blob_headers as headers
    from seriesloom.sources.blobs import encode_blobs

    h = headers(encode_blobs(event_points(spark, d), Config(DELTA, RAW)))
    return h.select(F.col("blob_id").alias("blob"), "kind", "blob_start", "n_metrics", "n_points", "n_bytes")


@query()
def encoding_matrix(spark, d):
    """Bytes per point of all pairs of timestamp and value codecs over the events' daily columns, without and with shared timestamps."""
    from seriesloom.operators.sizing import encoding_matrix as matrix

    return matrix(event_points(spark, d))


@query()
def analyze_sizes(spark, d):
    """All five models of delta and gorilla sizes over the whole set, ranked."""
    from seriesloom.operators.analysis import analyze

    return analyze(event_points(spark, d))


@query()
def analyze_sizes_each(spark, d):
    """The same for each day by itself."""
    from seriesloom.operators.analysis import analyze_each

    return analyze_each(event_points(spark, d))


@query(
    f"""WITH {PTS}, c AS (SELECT blob, ppm, pos // ppm AS chunk, count(DISTINCT metric) AS m, count(*) AS n FROM pts, {"(VALUES (1), (2), (5), (10), (20), (50), (100), (150), (200), (500), (1000), (2000), (5000)) AS l(ppm)"} GROUP BY ALL),
    k AS (SELECT blob, greatest(1, least(floor(avg(n)), quantile_disc(n, 0.9))) AS cap FROM (SELECT blob, metric, count(*) AS n FROM pts GROUP BY ALL) GROUP BY blob)
    SELECT blob, CAST(ppm AS BIGINT) AS ppm, CAST(sum(n) AS BIGINT) AS n_points, CAST(sum(32 + 16 * m + 16 * n) AS BIGINT) AS bytes FROM c JOIN k USING (blob) WHERE ppm <= cap GROUP BY ALL"""
)
def measured_sizes_each(spark, d):
    """Bytes of each day's points under raw encoding, re-chunked; lengths of the ladder only."""
    from seriesloom.operators.analysis import measured_each

    m = measured_each(event_points(spark, d), "raw", "raw").where(F.col("ppm").isin(resample.LADDER))
    return m.select(F.col("blob_id").alias("blob"), *_long("ppm", "n_points", "bytes"))


@query(
    f"""WITH {PTS} SELECT blob * 86400000000 AS blob_start, metric, count(*) AS n, min(t) AS first_ts, max(t) AS last_ts, round(sum(val), 4) AS total
    FROM pts GROUP BY ALL"""
)
def streaming_day_blobs(spark, d):
    """The events as a stream into one blob a day, run to the end over the table as it is."""
    from seriesloom.streaming.windows import finished_windows

    out = finished_windows(spark, f"{d}/events.parquet")
    return out.select("blob_start", F.col("metric_name").alias("metric"), "n", "first_ts", "last_ts", F.round("total", 4).alias("total"))


@query("SELECT name, n, ts_first, ts_last FROM (VALUES ('cpu.usage', 10, 1000000, 10000000), ('memory.usage', 10, 1000000, 10000000)) AS v(name, n, ts_first, ts_last)")
def json_import(spark, d):
    """A document in the column layout, written and read."""
    import uuid

    from seriesloom.runtime import shared_dir
    from seriesloom.sources.json import read_columns

    path = f"{shared_dir(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
    series = [F.struct(F.lit(n).alias("name"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (i * 1000).cast("long")).alias("timestamps"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i / F.lit(4.0)).alias("values")) for n in ("cpu.usage", "memory.usage")]
    spark.range(1).select(F.array(*series).alias("metrics")).write.json(path)
    rows = read_columns(spark, path, "ms")
    return rows.groupBy(F.col("metric_name").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("ts").cast("int").alias("ts_first"), F.max("ts").cast("int").alias("ts_last"))


@query("SELECT CAST(g AS BIGINT) AS pos, CAST(1700000000000000 + g * 60000000 AS BIGINT) AS ts FROM range(100) AS r(g)")
def generated_profile(spark, d):
    """A generated series with regular times."""
    from seriesloom.sources.generators import profile

    return profile(spark, "regular_scrape_60s", 1, 100).select(*_long("pos"), "ts")
