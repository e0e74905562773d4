"""Codecs: exact round trips and known sizes."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from seriesloom.codecs import alp, bits, timestamps, values
from seriesloom.errors import SeriesError

EDGES = [0.0, -0.0, 1.0, np.nan, np.inf, -np.inf, 5e-324, -5e-324, 1.7976931348623157e308, 0.1, 2.0**51 - 1, 2.0**51 + 1, -(2.0**53), 1e18, 123.45, 2**-1074]
COLUMNS = [np.array(EDGES[:n]) for n in range(8)] + [np.full(40, 7.25), np.array([1.5, 1.5, 2.5, 1.5]), np.random.default_rng(1).random(500), np.round(np.random.default_rng(2).random(300) * 100, 2), np.array([np.frombuffer(b"\x01\x00\x00\x00\x00\x00\xf8\x7f", "<f8")[0], np.nan])]
CODECS = [
    (values.encode_raw, values.decode_raw),
    (values.encode_gorilla, values.decode_gorilla),
    (values.encode_chimp, values.decode_chimp),
    (alp.encode, alp.decode),
    (lambda v: alp.encode(v, False), lambda d, n: alp.decode(d, n, False)),
]
TIMES = [
    (timestamps.encode_raw, timestamps.decode_raw),
    (timestamps.encode_delta, timestamps.decode_delta),
    (timestamps.encode_packed, timestamps.decode_packed),
]


def same(a, b):
    return np.array_equal(np.asarray(a, np.float64).view(np.uint64), np.asarray(b, np.float64).view(np.uint64))


@pytest.mark.parametrize("codec", range(len(CODECS)))
def test_edge_columns(codec):
    encode, decode = CODECS[codec]
    for c in COLUMNS:
        assert same(decode(encode(c), len(c)), c)


@given(st.lists(st.floats(width=64) | st.integers(-10_000, 10_000).map(lambda x: x / 100), max_size=80))
def test_any_values(v):
    v = np.array(v, np.float64)
    for encode, decode in CODECS:
        assert same(decode(encode(v), len(v)), v)


@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(1_700_000_000_000_000, 1_700_000_001_000_000), max_size=40))
def test_any_timestamps(ts):
    with np.errstate(over="ignore"):
        for encode, decode in TIMES:
            assert decode(encode(np.array(ts, np.int64)), len(ts)).tolist() == ts


def test_known_bytes():
    assert bits.put_varints(np.array([0, 1, 127, 128, 300, 2**64 - 1], np.uint64)) == b"\x00\x01\x7f\x80\x01\xac\x02" + b"\xff" * 9 + b"\x01"
    assert bits.zigzag(np.array([0, -1, 1, -2])).tolist() == [0, 1, 2, 3]
    ts = np.arange(6) * 60_000_000 + 1_704_067_200_000_000
    assert len(timestamps.encode_delta(ts)) == 8 + 4 + 4 and len(timestamps.encode_packed(ts)) == 8 + 4 + 1 + 4
    assert len(values.encode_gorilla(np.full(9, 3.5))) == 9  # 64 bits and 8 single bits
    assert len(values.encode_chimp(np.full(5, 3.5))) == 9  # 64 bits and 4 pairs
    assert alp.encode(np.full(4, 7.0))[:4] == bytes([0, 0, 0, 0]) and len(alp.encode(np.full(4, 7.0))) == 16


def test_published_shapes_are_reached():
    """Columns of two-decimal gauges take less than a third of raw under the decimal scheme, and none is larger than raw by more than its scheme byte."""
    rng = np.random.default_rng(5)
    gauge = np.round(100 + np.cumsum(rng.normal(0, 0.05, 1000)), 2)
    assert len(alp.encode(gauge)) < 8 * 1000 / 3
    assert len(alp.encode(rng.random(1000))) <= 8001
    counter = np.cumsum(rng.integers(1, 11, 1000)).astype(float)
    assert len(alp.encode(counter)) < 2000


@pytest.mark.parametrize("codec", [1, 2, 3])
def test_cut_off_columns_are_errors(codec):
    encode, decode = CODECS[codec]
    data = encode(np.random.default_rng(1).random(50))
    for n in (0, 1, 5, len(data) // 2, len(data) - 1):
        with pytest.raises(SeriesError):
            decode(data[:n], 50)
    for n in (0, 5):
        with pytest.raises(SeriesError):
            timestamps.decode_packed(timestamps.encode_packed(np.arange(20) ** 3)[:n], 20)
    with pytest.raises(SeriesError):
        alp.decode(b"\x03abc", 2)
