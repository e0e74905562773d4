"""WARC records and the Merkle audit."""

import gzip
from hashlib import sha256

import pytest

from seriesloom.llm import warc
from seriesloom.runtime import cut


def pages(spark, n=40):
    rows = [(i, f"http://h/{i}\r\nX: y" if i == 3 else f"http://h/{i}", "<p>é\r\n\r\n" * (i * 37 % 400), "z") for i in range(n)] + [(5, "u", None, "z"), (None, None, "q", "z"), (5, "u", None, "z")]
    return cut(spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(3))


def test_files_round_trip(spark, tmp_path):
    df = pages(spark)
    for kind in ("gzip", "none"):
        path = str(tmp_path / kind)
        warc.write_warc(df, path, kind)
        back = warc.read_warc(spark, path).collect()
        assert sorted(bytes(r.block).decode() for r in back) == sorted(r.html or "" for r in df.collect())
        assert "http://h/3%0D%0AX: y" in {r.uri for r in back}
        assert sorted(r.digest for r in back) == sorted(sha256(r.record.encode()).hexdigest() for r in warc.records(df).collect())
        at = {}
        for r in sorted(back, key=lambda r: (r.volume, r.offset)):
            assert r.offset == at.get(r.volume, 0)
            at[r.volume] = r.offset + r.length
        assert len(at) > 1 and all(r.block is None for r in warc.read_warc(spark, path, blocks=False).collect())
    warc.write_warc(df.limit(0), str(tmp_path / "empty"))
    assert warc.read_warc(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n", b"WARC/1.1\r\n", b"nothing\r\n\r\n", b"WARC/1.1\r\nContent-Type: x\r\n\r\n"])
def test_damaged_files_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.parse_warc([data]))
    with pytest.raises(ValueError):
        list(warc.parse_warc(warc.content(gzip.compress(b"WARC/1.1 " * 9)[:-12])))


def test_records_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    one = lambda body: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    bodies = [b"", b"\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 3000]
    for data in (b"".join(map(one, bodies)), gzip.compress(b"".join(map(one, bodies))), b"".join(gzip.compress(one(b)) for b in bodies)):
        assert [r[3] for r in warc.parse_warc(warc.content(data))] == bodies


def brute(a, b):
    x, y = ({(r.volume, r.offset): (r.length, r.digest) for r in t.collect()} for t in (a, b))
    return sorted((*k, *x.get(k, (None, None)), *y.get(k, (None, None))) for k in x.keys() | y.keys() if x.get(k) != y.get(k))


@pytest.mark.parametrize("change", ["none", "byte", "missing", "extra", "longer", "volume", "empty"])
def test_audit_finds_just_what_differs(spark, change):
    rows = [(f"v{v}", o * 40_000, 40_000, sha256(f"{v}:{o}".encode()).hexdigest()) for v in range(3) for o in range(60)]
    other = list(rows)
    if change == "byte":
        other[17] = (*other[17][:3], "x")
        other[100] = (*other[100][:3], "y")
    elif change == "missing":
        del other[59], other[3]
    elif change == "extra":
        other.append(("v1", 60 * 40_000 + 7, 5, "z"))
    elif change == "longer":
        other.append(("v2", 9_000_000_000, 5, "z"))
    elif change == "volume":
        other = [r for r in other if r[0] != "v1"]
    elif change == "empty":
        other = []
    schema = "volume string, offset long, length long, digest string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    for x, y in ((a, b), (b, a)):
        assert sorted(map(tuple, warc.audit(x, y).collect()), key=str) == sorted(brute(x, y), key=str)
    assert (warc.root(warc.tree(a)) == warc.root(warc.tree(b))) == (change == "none")
