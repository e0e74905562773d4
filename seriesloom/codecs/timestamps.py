"""Timestamp columns: raw, delta of delta as varints, and delta of delta in groups of four.

Both delta forms begin with the first timestamp as a plain unsigned varint and
the first difference as a zigzag one; differences wrap around like int64.
"""

from __future__ import annotations

import numpy as np

from seriesloom.codecs.bits import get_varints, put_varints, unzigzag, zigzag
from seriesloom.errors import SeriesError

#: Numbers of a group, and the bytes that a two-bit tag stands for.
GROUP, LENGTHS = 4, np.array([1, 2, 4, 8])


def encode_raw(ts: np.ndarray, little: bool = True) -> bytes:
    return np.asarray(ts, np.int64).astype("<i8" if little else ">i8").tobytes()


def decode_raw(data: bytes, count: int, little: bool = True) -> np.ndarray:
    if len(data) < 8 * count:
        raise SeriesError("InvalidTimestampData")
    return np.frombuffer(data, "<i8" if little else ">i8", count).astype(np.int64)


def _steps(ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the two leading numbers, zigzag differences of differences)."""
    ts = np.asarray(ts, np.int64)
    d = np.diff(ts)
    return np.concatenate([ts[:1].view(np.uint64), zigzag(d[:1])]), zigzag(np.diff(d))


def _summed(head: np.ndarray, dd: np.ndarray) -> np.ndarray:
    first = head[:1].view(np.int64)
    d = np.cumsum(np.concatenate([unzigzag(head[1:2]), dd]))
    return np.concatenate([first, first + np.cumsum(d)]) if len(head) > 1 else first


def encode_delta(ts: np.ndarray) -> bytes:
    return put_varints(np.concatenate(_steps(ts)))


def decode_delta(data: bytes, count: int) -> np.ndarray:
    u, _ = get_varints(data, count)
    return _summed(u[:2].copy(), unzigzag(u[2:]))


def encode_packed(ts: np.ndarray) -> bytes:
    head, z = _steps(ts)
    tag = (z > 0xFF).astype(np.uint8) + (z > 0xFFFF) + (z > 0xFFFFFFFF)
    n = len(z)
    groups = -(-n // GROUP)
    tags = np.zeros(groups * GROUP, np.uint8)
    tags[:n] = tag
    control = (tags.reshape(-1, GROUP) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    rows = np.zeros((groups * GROUP, 8), np.uint8)
    rows[:n] = z.astype("<u8").view(np.uint8).reshape(-1, 8)
    keep = np.arange(8) < LENGTHS[tags][:, None]
    keep[n:] = False
    whole = np.concatenate([control[:, None], rows.reshape(groups, GROUP * 8)], axis=1)
    inside = np.concatenate([np.ones((groups, 1), bool), keep.reshape(groups, GROUP * 8)], axis=1)
    return put_varints(head) + whole[inside].tobytes()


def decode_packed(data: bytes, count: int) -> np.ndarray:
    head, at = get_varints(data, min(2, count))
    n = max(0, count - 2)
    out = np.zeros(n, np.uint64)
    for k in range(0, n, GROUP):
        if at >= len(data):
            raise SeriesError("InvalidTimestampData", "a group is cut off")
        control, at = data[at], at + 1
        for i in range(k, min(k + GROUP, n)):
            size = int(LENGTHS[control >> 2 * (i - k) & 3])
            if at + size > len(data):
                raise SeriesError("InvalidTimestampData", "a group is cut off")
            out[i] = int.from_bytes(data[at : at + size], "little")
            at += size
    return _summed(head.copy(), unzigzag(out))
