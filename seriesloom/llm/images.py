"""Local image descriptors in numpy: corners at several scales, and binary tests turned by the corner's orientation.

Images are 8-bit grey, as binary PGM (P5). All corners that are the strongest
of their neighbourhood and strong enough are taken; their number is bounded by
the image's area.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Factors by which an image is shrunk; corner spacing; border kept free; least corner strength; tests of a descriptor.
SCALES, SPACING, BORDER, LEAST, TESTS = (1.0, 1.5, 2.25), 3, 9, 40.0, 256
#: Radius of a patch; directions in which the tests are prepared.
RADIUS, TURNS = 8, 32
_HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels, or none for null, damaged or other data."""
    m = _HEAD.match(data or b"")
    if not m or not 0 < int(m[3]) < 256:
        return None
    w, h = int(m[1]), int(m[2])
    body = np.frombuffer(data, np.uint8, offset=m.end())
    return body[: w * h].reshape(h, w) if w and h and len(body) >= w * h else None


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _blurred(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    a = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]) / 4


def _shrunk(a: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear samples of the blurred image."""
    if factor == 1.0:
        return a
    a = _blurred(_blurred(a))
    h, w = max(1, int(a.shape[0] / factor)), max(1, int(a.shape[1] / factor))
    y, x = np.minimum(np.arange(h) * factor, a.shape[0] - 1), np.minimum(np.arange(w) * factor, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def _strength(a: np.ndarray) -> np.ndarray:
    """The smaller eigenvalue of the structure tensor at each pixel."""
    p = np.pad(a, 1, mode="edge")
    gx, gy = (p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2
    xx, yy, xy = _blurred(_blurred(gx * gx)), _blurred(_blurred(gy * gy)), _blurred(_blurred(gx * gy))
    return (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)


def _corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _strength(a)
    p = np.pad(s, SPACING, constant_values=-1)
    top = s
    for axis in (0, 1):
        n = s.shape[axis]
        q = p if axis == 0 else np.pad(top, ((0, 0), (SPACING, SPACING)), constant_values=-1)
        views = [np.take(q, range(k, k + n), axis=axis) for k in range(2 * SPACING + 1)]
        top = np.maximum.reduce(views)
        if axis == 0:
            top = top[:, SPACING:-SPACING]
    ok = (s == top) & (s > LEAST)
    ok[:BORDER], ok[-BORDER:], ok[:, :BORDER], ok[:, -BORDER:] = False, False, False, False
    return np.nonzero(ok)


@lru_cache(maxsize=1)
def _tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(disc offsets, their weights for the centroid, test offsets [turn][test][end][y, x]); from a fixed seed."""
    rng = np.random.default_rng(2024)
    points = np.clip(rng.standard_normal((TESTS, 2, 2)) * RADIUS / 2, -RADIUS + 2, RADIUS - 2)
    points[:, 1, 1] = points[:, 0, 1]  # across the orientation: along it, the slope that defines it decides every test alike
    too_far = np.hypot(points[..., 0], points[..., 1]) > RADIUS - 1
    points[too_far] *= 0.5
    angles = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(angles), np.sin(angles)], 1), np.stack([-np.sin(angles), np.cos(angles)], 1)], 1)  # on (y, x)
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = np.stack([y, x], -1)[np.hypot(y, x) <= RADIUS]
    return disc, disc.astype(float), np.round(np.einsum("tij,nej->tnei", turn, points)).astype(int)


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, descriptors): places [x, y, scale, turn] in the full image's pixels, float32; descriptors 4 x uint64."""
    disc, weights, tests = _tests()
    places, bits = [], []
    for scale in SCALES:
        a = _shrunk(pixels.astype(np.float64), scale)
        if min(a.shape) <= 2 * BORDER:
            break
        y, x = _corners(a)
        if not len(y):
            continue
        around = a[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        angle = np.arctan2(around @ weights[:, 0], around @ weights[:, 1])
        turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        at = tests[turn]
        smooth = _blurred(_blurred(a))
        ends = smooth[y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
        bits.append(np.packbits(ends[..., 0] < ends[..., 1], axis=1, bitorder="little").view("<u8"))
        places.append(np.stack([x * scale, y * scale, np.full(len(x), scale), angle], 1).astype(np.float32))
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, 4), np.uint64)
    return np.concatenate(places), np.concatenate(bits)
