"""The registered queries over a small test table: against SQL where there is some, else their shape."""

import duckdb
import pytest

from seriesloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
COLUMNS = {
    "op4_lm_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, DATA)
    rows = out.collect()
    if name in COLUMNS:
        assert dict(out.dtypes) == COLUMNS[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    if name not in ORACLE_SQL:
        table, key = {"op5_media": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
        assert len({r[key] for r in rows}) == con.execute(f"SELECT count(DISTINCT {key}) FROM {table}").fetchall()[0][0]
        return
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(out.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(tuple(r[k] for k in at) for r in want.fetchall())
