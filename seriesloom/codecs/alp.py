"""Adaptive lossless floats: decimals as integers, or a dictionary of left parts, or raw.

After Afroozeh, Kuffo and Boncz, "ALP: Adaptive Lossless floating-Point
Compression", SIGMOD 2024. A column is the scheme's byte and, for
  0 decimals: e, f, width, exceptions u32, least i64; codes; (position u32, value f64) of exceptions
  1 split:    right width, code bits, entries, exceptions u32; entries u16; left codes; right parts; (position u32, left u16)
  2 raw:      the values.
"""

from __future__ import annotations

import numpy as np

from seriesloom.codecs.bits import pack_low, unpack_low
from seriesloom.errors import SeriesError

#: Fixed values of the format: powers of ten, sample size, largest left part, entries of a dictionary, bits of headers and exceptions.
MAX_EXPONENT, SAMPLE, MAX_LEFT, ENTRIES = 18, 32, 16, 8
POW10 = np.array([float(f"1e{k}") for k in range(MAX_EXPONENT + 1)])
INV10 = np.array([float(f"1e-{k}") for k in range(MAX_EXPONENT + 1)])
DECIMAL_HEAD, DECIMAL_EXCEPTION, SPLIT_HEAD, SPLIT_EXCEPTION = 120, 96, 56, 48
DECIMAL, SPLIT, RAW = 0, 1, 2


def _digits(v: np.ndarray, e: int | np.ndarray, f: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(round(v * 10^e * 10^-f), whether it is an int64); halves to even below 2^51, away from zero beyond."""
    with np.errstate(all="ignore"):
        scaled = v * POW10[e] * INV10[f]
        small = np.abs(scaled) < 2.0**51
        r = np.where(small, np.rint(scaled), np.trunc(scaled + np.copysign(0.5, scaled)))
        ok = small | (np.abs(r) < 9.2e18)
        return np.where(ok, r, 0).astype(np.int64), ok


def _best_exponents(v: np.ndarray) -> tuple[int, int]:
    """The first (e, f), f <= e, with the least estimated size of the sample."""
    e, f = np.array([(e, f) for e in range(MAX_EXPONENT + 1) for f in range(e + 1)]).T
    d, ok = _digits(v[None, :], e[:, None], f[:, None])
    with np.errstate(all="ignore"):
        ok &= d * POW10[f][:, None] * INV10[e][:, None] == v
    top = np.where(ok, d, np.iinfo(np.int64).min).max(axis=1)
    low = np.where(ok, d, np.iinfo(np.int64).max).min(axis=1)
    bad = (~ok).sum(axis=1)
    width = [int(int(a) - int(b)).bit_length() if n < len(v) else 0 for a, b, n in zip(top, low, bad, strict=True)]
    best = int(np.argmin(len(v) * np.array(width) + bad * DECIMAL_EXCEPTION))
    return int(e[best]), int(f[best])


def _code_bits(n: int) -> int:
    return 1 if n <= 1 else (n - 1).bit_length()


def _dictionary(left: np.ndarray) -> tuple[np.ndarray, int]:
    """(most frequent left parts, smaller ones first among equals; how many values they cover)."""
    parts, counts = np.unique(left, return_counts=True)
    order = np.lexsort((parts, -counts))[:ENTRIES]
    return parts[order], int(counts[order].sum())


def _best_cut(bits: np.ndarray) -> int:
    """The width of the right part with the least estimated size of the sample."""
    best = None
    for left in range(1, MAX_LEFT + 1):
        right = 64 - left
        entries, covered = _dictionary(bits >> np.uint64(right))
        n = len(bits)
        size = SPLIT_HEAD + len(entries) * 16 + n * (_code_bits(len(entries)) + right) + (n - covered) * SPLIT_EXCEPTION
        if best is None or size < best[0]:
            best = (size, right)
    return best[1]


def encode(v: np.ndarray, little: bool = True) -> bytes:
    v = np.asarray(v, np.float64)
    n = len(v)
    if not n:
        return b""
    order = "<" if little else ">"
    stride = n // SAMPLE if n > SAMPLE else 1
    bits = v.view(np.uint64)
    e, f = _best_exponents(v[::stride])
    d, ok = _digits(v, e, f)
    ok &= (d * POW10[f] * INV10[e]).view(np.uint64) == bits
    bad = np.flatnonzero(~ok)
    decimal = None
    if len(bad) < n:
        least = int(d[ok].min())
        width = (int(d[ok].max()) - least).bit_length()
        decimal = DECIMAL_HEAD + n * width + len(bad) * DECIMAL_EXCEPTION

    def decimals() -> bytes:
        codes = (d - np.int64(least)).view(np.uint64).copy()
        codes[bad] = 0
        head = bytes([DECIMAL, e, f, width]) + np.array([len(bad)], order + "u4").tobytes() + np.array([least], order + "i8").tobytes()
        exceptions = np.zeros(len(bad), np.dtype([("p", order + "u4"), ("v", order + "f8")]))
        exceptions["p"], exceptions["v"] = bad, v[bad]
        return head + pack_low(codes, width) + exceptions.tobytes()

    if decimal is not None and not len(bad) and decimal <= 64 * n:
        return decimals()
    right = _best_cut(bits[::stride])
    left = bits >> np.uint64(right)
    entries, covered = _dictionary(left)
    code_bits = _code_bits(len(entries))
    split = SPLIT_HEAD + len(entries) * 16 + n * (code_bits + right) + (n - covered) * SPLIT_EXCEPTION
    if decimal is not None and decimal <= split and decimal <= 64 * n:
        return decimals()
    if split <= 64 * n:
        where = left[:, None] == entries
        known = where.any(axis=1)
        out = np.flatnonzero(~known)
        exceptions = np.zeros(len(out), np.dtype([("p", order + "u4"), ("l", order + "u2")]))
        exceptions["p"], exceptions["l"] = out, left[out]
        head = bytes([SPLIT, right, code_bits, len(entries)]) + np.array([len(out)], order + "u4").tobytes() + entries.astype(order + "u2").tobytes()
        codes = np.where(known, where.argmax(axis=1), 0).astype(np.uint64)
        return head + pack_low(codes, code_bits) + pack_low(bits & ((np.uint64(1) << np.uint64(right)) - np.uint64(1)), right) + exceptions.tobytes()
    return bytes([RAW]) + v.astype(order + "f8").tobytes()


def decode(data: bytes, count: int, little: bool = True) -> np.ndarray:
    if not count:
        return np.zeros(0)
    if not data or data[0] > RAW:
        raise SeriesError("InvalidALPScheme")
    order = "<" if little else ">"
    if data[0] == RAW:
        if len(data) < 1 + 8 * count:
            raise SeriesError("InvalidALPColumn")
        return np.frombuffer(data, order + "f8", count, 1).astype(np.float64)
    if len(data) < 8:
        raise SeriesError("InvalidALPColumn")
    bad = int(np.frombuffer(data, order + "u4", 1, 4)[0])
    if data[0] == DECIMAL:
        e, f, width = data[1:4]
        size = (count * width + 7) // 8
        if e > MAX_EXPONENT or f > e or width > 64 or len(data) < 16 + size + 12 * bad or bad > count:
            raise SeriesError("InvalidALPColumn")
        least = np.frombuffer(data, order + "i8", 1, 8).astype(np.int64)[0]
        codes = unpack_low(data[16 : 16 + size], count, width).view(np.int64)
        with np.errstate(over="ignore"):
            out = (codes + least) * POW10[f] * INV10[e]
        exceptions = np.frombuffer(data, np.dtype([("p", order + "u4"), ("v", order + "u8")]), bad, 16 + size)
        if bad and exceptions["p"].max() >= count:
            raise SeriesError("InvalidALPColumn")
        bits = out.view(np.uint64)
        bits[exceptions["p"]] = exceptions["v"]
        return out
    right, code_bits, n = data[1:4]
    sizes = 2 * n, (count * code_bits + 7) // 8, (count * right + 7) // 8
    if not 48 <= right < 64 or n > ENTRIES or code_bits > 3 or len(data) < 8 + sum(sizes) + 6 * bad or bad > count:
        raise SeriesError("InvalidALPColumn")
    entries = np.frombuffer(data, order + "u2", n, 8).astype(np.uint64)
    a, b = 8 + sizes[0], 8 + sizes[0] + sizes[1]
    codes = unpack_low(data[a:b], count, code_bits).astype(np.int64)
    if not n or codes.max() >= n:
        raise SeriesError("InvalidALPColumn")
    left = entries[codes]
    exceptions = np.frombuffer(data, np.dtype([("p", order + "u4"), ("l", order + "u2")]), bad, b + sizes[2])
    if bad and exceptions["p"].max() >= count:
        raise SeriesError("InvalidALPColumn")
    left[exceptions["p"]] = exceptions["l"]
    return (left << np.uint64(right) | unpack_low(data[b : b + sizes[2]], count, right)).view(np.float64)
