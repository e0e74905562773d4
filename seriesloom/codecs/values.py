"""Value columns of doubles, by their bits: raw, and two codecs of the XOR with the value before."""

from __future__ import annotations

import numpy as np

from seriesloom.codecs.bits import BitReader, leading_zeros, put_bits, trailing_zeros
from seriesloom.errors import SeriesError

#: Fixed values of the second XOR codec: lower bounds of its eight classes of leading zeros, and the trailing zeros beyond which they are cut off.
LEADING = np.array([0, 8, 12, 16, 18, 20, 22, 24])
TRAILING = 6


def encode_raw(v: np.ndarray, little: bool = True) -> bytes:
    return np.asarray(v, np.float64).astype("<f8" if little else ">f8").tobytes()


def decode_raw(data: bytes, count: int, little: bool = True) -> np.ndarray:
    if len(data) < 8 * count:
        raise SeriesError("InvalidValueData")
    return np.frombuffer(data, "<f8" if little else ">f8", count).astype(np.float64)


def _xors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.asarray(v, np.float64).view(np.uint64)
    return bits, bits[1:] ^ bits[:-1]


def encode_gorilla(v: np.ndarray) -> bytes:
    """0: same; 10: in the last window; 11, five bits of leading zeros, six of length - 1: a new window."""
    bits, xor = _xors(v)
    if not len(bits):
        return b""
    lead = np.minimum(leading_zeros(xor), 31)
    trail = np.where(xor == 0, 0, np.maximum(trailing_zeros(xor) - np.maximum(leading_zeros(xor) - 31, 0), 0))
    # A window reaches from `window[0]` leading to `window[1]` trailing zeros; which one holds depends on those chosen before.
    head, head_bits = np.zeros(len(xor), np.uint64), np.ones(len(xor), np.int64)
    shift, size = np.zeros(len(xor), np.uint64), np.zeros(len(xor), np.int64)
    window = None
    for i in np.flatnonzero(xor).tolist():
        a, b = int(lead[i]), int(trail[i])
        if window is not None and a >= window[0] and b >= window[1]:
            head[i], head_bits[i] = 0b10, 2
        else:
            window = (a, b)
            head[i], head_bits[i] = 0b11 << 11 | a << 6 | (63 - a - b), 13
        shift[i], size[i] = window[1], 64 - window[0] - window[1]
    values = np.stack([head, xor >> shift], axis=1).reshape(-1)
    widths = np.stack([head_bits, size], axis=1).reshape(-1)
    return put_bits(np.concatenate([bits[:1], values]), np.concatenate([[64], widths]))


def decode_gorilla(data: bytes, count: int) -> np.ndarray:
    out = np.zeros(count, np.uint64)
    if count:
        r = BitReader(data)
        last = r.take(64)
        out[0] = last
        trail = size = 0
        for i in range(1, count):
            if r.take(1):
                if r.take(1):
                    lead = r.take(5)
                    size = r.take(6) + 1
                    trail = 64 - lead - size
                    if trail < 0:
                        raise SeriesError("InvalidValueData", "a window is wider than a value")
                elif not size:
                    raise SeriesError("InvalidValueData", "a window is used before it is given")
                last ^= r.take(size) << trail
            out[i] = last
    return out.view(np.float64)


def encode_chimp(v: np.ndarray) -> bytes:
    """00: same; 01, class of leading zeros, length: cut off at both ends; 10: leading zeros as before; 11: a new class of them."""
    bits, xor = _xors(v)
    if not len(bits):
        return b""
    zeros = leading_zeros(xor)
    kind = np.searchsorted(LEADING, np.minimum(zeros, 63), "right") - 1
    lead = LEADING[kind]
    trail = trailing_zeros(xor)
    same, cut = xor == 0, (xor != 0) & (trail > TRAILING)
    plain = ~same & ~cut
    # The class before counts only if the value before was plain as well.
    again = plain & np.concatenate(([False], plain[:-1] & (lead[1:] == lead[:-1])))
    new = plain & ~again
    head, head_bits = np.zeros(len(xor), np.uint64), np.full(len(xor), 2)
    size = np.where(plain, 64 - lead, 0)
    middle = np.where(cut, np.maximum(64 - lead - trail, 1), 0)
    head[cut] = (1 << 9 | kind << 6 | middle & 0x3F)[cut]
    head_bits[cut], size[cut] = 11, middle[cut]
    head[again] = 2
    head[new] = (3 << 3 | kind)[new]
    head_bits[new] = 5
    shift = np.where(cut, trail, 0).astype(np.uint64)
    values = np.stack([head, xor >> shift], axis=1).reshape(-1)
    widths = np.stack([head_bits, size], axis=1).reshape(-1)
    return put_bits(np.concatenate([bits[:1], values]), np.concatenate([[64], widths]))


def decode_chimp(data: bytes, count: int) -> np.ndarray:
    out = np.zeros(count, np.uint64)
    if count:
        r = BitReader(data)
        last = r.take(64)
        out[0] = last
        lead = None
        for i in range(1, count):
            flag = r.take(2)
            if flag == 0:
                lead = None
            elif flag == 1:
                zeros = int(LEADING[r.take(3)])
                size = r.take(6) or 64
                if zeros + size > 64:
                    raise SeriesError("InvalidValueData", "a value is wider than 64 bits")
                last ^= r.take(size) << (64 - zeros - size)
                lead = None
            else:
                if flag == 3:
                    lead = int(LEADING[r.take(3)])
                elif lead is None:
                    raise SeriesError("InvalidValueData", "leading zeros are used before they are given")
                last ^= r.take(64 - lead)
            out[i] = last
    return out.view(np.float64)
