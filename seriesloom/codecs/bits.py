"""Bit streams and variable-length integers on whole arrays."""

from __future__ import annotations

import numpy as np

from seriesloom.errors import SeriesError

_ONE = np.uint64(1)


def zigzag(x: np.ndarray) -> np.ndarray:
    """int64 to uint64, small numbers of either sign to small ones."""
    x = x.astype(np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.uint64)
    return (u >> _ONE).view(np.int64) ^ -(u & _ONE).view(np.int64)


def put_varints(u: np.ndarray) -> bytes:
    """LEB128 of each number, one after the other."""
    u = np.asarray(u, np.uint64)
    if not len(u):
        return b""
    digits = (u[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))) & np.uint64(0x7F)
    size = np.maximum(1, 10 - np.argmax(digits[:, ::-1] != 0, axis=1))
    size[~(digits != 0).any(axis=1)] = 1
    inside = np.arange(10) < size[:, None]
    more = np.arange(10) < size[:, None] - 1
    return (digits.astype(np.uint8) | (more * 0x80).astype(np.uint8))[inside].tobytes()


def get_varints(data: bytes, count: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(numbers, offset after them) of the first `count` LEB128 numbers."""
    if count == 0:
        return np.zeros(0, np.uint64), at
    raw = np.frombuffer(data, np.uint8, offset=at)
    raw = raw[: count * 10]
    ends = np.flatnonzero(raw < 0x80)[:count]
    if len(ends) < count:
        raise SeriesError("InvalidTimestampData", "a number is cut off")
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts + 1
    if size.max() > 10:
        raise SeriesError("InvalidTimestampData", "a number is too long")
    k = np.arange(size.max())
    place = starts[:, None] + k
    digit = (raw[np.minimum(place, len(raw) - 1)] & 0x7F).astype(np.uint64) * (k < size[:, None])
    return (digit << (k.astype(np.uint64) * np.uint64(7))).sum(axis=1, dtype=np.uint64), at + int(ends[-1]) + 1


def put_varint(n: int) -> bytes:
    """LEB128 of one number of 64 bits."""
    if n < 0x80:
        return bytes((n,))
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, offset after it) of the LEB128 number at an offset; bits beyond 64 fall off."""
    n = shift = 0
    for k in range(at, len(data)):
        n |= (data[k] & 0x7F) << shift
        if data[k] < 0x80:
            if k - at >= 10:
                raise SeriesError("InvalidTimestampData", "a number is too long")
            return n & 0xFFFFFFFFFFFFFFFF, k + 1
        if k - at >= 10:
            break
        shift += 7
    raise SeriesError("InvalidTimestampData", "a number is cut off")


def put_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """The low `width` bits of each value, most significant first; the last byte is filled up with zeros."""
    values, widths = np.asarray(values, np.uint64), np.asarray(widths, np.int64)
    keep = widths > 0
    values, widths = values[keep], widths[keep]
    if not len(widths):
        return b""
    ends = np.cumsum(widths)
    total = int(ends[-1])
    words = np.zeros(total // 64 + 2, np.uint64)
    start = ends - widths
    word, shift = start >> 6, (start & 63).astype(np.uint64)
    top = values << (64 - widths).astype(np.uint64)
    np.bitwise_or.at(words, word, top >> shift)
    spill = shift > 0
    np.bitwise_or.at(words, word[spill] + 1, top[spill] << (np.uint64(64) - shift[spill]))
    return words.astype(">u8").tobytes()[: (total + 7) // 8]


class BitReader:
    """Reads a most-significant-first bit stream."""

    def __init__(self, data: bytes):
        self.words = np.frombuffer(data + bytes(16 + -len(data) % 8), ">u8").tolist()
        self.size, self.at = len(data) * 8, 0

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.size:
            raise SeriesError("InvalidValueData", "the column is cut off")
        word, shift = at >> 6, at & 63
        both = self.words[word] << 64 | self.words[word + 1]
        return both >> (128 - shift - n) & ((1 << n) - 1)


def pack_low(codes: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each code, least significant first."""
    if width == 0 or not len(codes):
        return b""
    bits = np.unpackbits(np.ascontiguousarray(codes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_low(data: bytes, count: int, width: int) -> np.ndarray:
    if width == 0 or count == 0:
        return np.zeros(count, np.uint64)
    need = (count * width + 7) // 8
    if len(data) < need:
        raise SeriesError("InvalidALPColumn")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, need), bitorder="little")[: count * width].reshape(count, width)
    full = np.zeros((count, 64), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of uint64; 64 for zero."""
    x = x.astype(np.uint64)
    n = np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= (_ONE << np.uint64(step))
        n += np.where(big, step, 0)
        x = np.where(big, x >> np.uint64(step), x)
    return np.where(x == 0, 64, 63 - n)


def trailing_zeros(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return np.where(x == 0, 64, 63 - leading_zeros(x & (~x + _ONE)))
