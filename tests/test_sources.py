"""JSON imports, generators, streams and the query catalogue."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesloom.sources import generators
from seriesloom.sources.json import read_columns, read_metric_documents, read_rows, write_report

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def put(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_columns_and_rows(spark, tmp_path):
    a = put(tmp_path / "a.json", {"metrics": [{"name": "cpu.usage", "timestamps": [1, 2, 5], "values": [1.5, 2.5, 3]}, {"id": "12345678901234", "timestamps": [7], "values": [1]}]})
    b = put(tmp_path / "b.json", {"metrics": [{"name": "cpu.usage", "points": [{"timestamp": 1, "value": 1.5}, {"timestamp": 2, "value": 2.5}]}, {"id": "18446744073709551615", "points": [{"timestamp": 7, "value": 1}]}]})
    rows = {(r.metric_id, r.metric_name, r.pos, r.ts, r.val) for r in read_columns(spark, a, "ms").collect()}
    cpu = 1823322468301511050
    assert rows == {(cpu, "cpu.usage", 0, 1000, 1.5), (cpu, "cpu.usage", 1, 2000, 2.5), (cpu, "cpu.usage", 2, 5000, 3.0), (12345678901234, None, 0, 7000, 1.0)}
    rows = {(r.metric_id, r.pos, r.ts, r.val) for r in read_rows(spark, b, "s").collect()}
    assert rows == {(cpu, 0, 1_000_000, 1.5), (cpu, 1, 2_000_000, 2.5), (-1, 0, 7_000_000, 1.0)}


@pytest.mark.parametrize(
    "metric, what",
    [
        ({"timestamps": [1], "values": [1]}, "InvalidInput"),
        ({"id": "1", "name": "x", "timestamps": [1], "values": [1]}, "InvalidInput"),
        ({"name": "x", "timestamps": [1, 2], "values": [1]}, "DataPointCountMismatch"),
        ({"name": "x", "timestamps": [2, 2], "values": [1, 1]}, "InvalidInput"),
    ],
)
def test_bad_input(spark, tmp_path, metric, what):
    with pytest.raises(Exception, match=what):
        read_columns(spark, put(tmp_path / "x.json", {"metrics": [metric]})).collect()


def test_units(spark, tmp_path):
    path = put(tmp_path / "x.json", {"metrics": [{"name": "x", "timestamps": [-1500, 1999], "values": [1, 1]}]})
    assert sorted(r.ts for r in read_columns(spark, path, "ns").collect()) == [-1, 1]
    with pytest.raises(ValueError):
        read_columns(spark, path, "h")


def test_nested_documents(spark, tmp_path):
    path = put(tmp_path / "n.json", {"ToolID": "T", "ContextID": "C", "Other": [1, {"x": 2}], "MetricValues": [{"Name": "m", "Values": [{"t": 5, "v": 1.5, "a": "g"}, {"t": 4, "v": 2}]}, {"Name": "empty", "Values": []}]})
    rows = [(r.ToolID, r.metric_name, r.pos, r.ts, r.val, r.tag) for r in read_metric_documents(spark, path).orderBy("pos").collect()]
    assert rows == [("T", "m", 0, 5, 1.5, "g"), ("T", "m", 1, 4, 2.0, "")]
    with pytest.raises(ValueError):
        read_metric_documents(spark, path, time="v")


def test_reports(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.col("id") * 2)
    write_report(df, str(tmp_path / "c"))
    write_report(df, str(tmp_path / "j"), "json")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3 and spark.read.json(str(tmp_path / "j")).count() == 3


def test_generators(spark):
    a, b = (generators.random_walk(spark, 5, 20, shared=True) for _ in range(2))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.groupBy("pos").agg(F.count_distinct("ts").alias("n")).where("n > 1").count() == 0
    assert generators.random_walk(spark, 5, 20).groupBy("pos").agg(F.count_distinct("ts").alias("n")).where("n > 1").count() > 0
    for name in generators.PROFILES:
        p = generators.profile(spark, name, 2, 60)
        assert p.count() == 120 and p.where("val is null").count() == 0
    steps = [r.ts for r in generators.profile(spark, "bursty_scrape", 1, 60).orderBy("pos").collect()]
    assert steps[50] - steps[49] == 20_000_000 and steps[1] - steps[0] == 15_000_000
    with pytest.raises(ValueError):
        generators.profile(spark, "none")
    assert generators.text_events(spark, 2, 3).first().val.endswith("processing_complete")


def test_entry_imports_without_the_llm_package(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "seriesloom"), tmp_path / "seriesloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def _names():
    from seriesloom.plans.catalogue import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", _names())
def test_catalogue(spark, db, name):
    from seriesloom.plans.catalogue import ORACLE, QUERIES

    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    if name not in ORACLE:
        assert rows
        if "n_mismatch" in columns:
            assert all(r[columns.index("n_mismatch")] == 0 for r in rows)
        return
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
