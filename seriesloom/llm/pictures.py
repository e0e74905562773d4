"""Pictures for a table without any: a vector decides what is on its picture, a number how a copy of it is edited."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.images import encode_pgm

#: Pixels of a side; rectangles on a picture; the coarser grid of its shading; grey levels of a patch's shading.
SIDE, SHAPES, GRID, SHADES = 80, 16, 20, 70


def picture(vector: list[float] | None) -> np.ndarray:
    """Overlapping rectangles on an uneven ground, drawn from a seed that is the vector's digest."""
    seed = sha256(np.array(vector or [], np.float32).tobytes()).digest()
    rng = np.random.default_rng(int.from_bytes(seed[:8], "little"))
    out = np.full((SIDE, SIDE), rng.integers(256), np.int64)
    for y, x, h, w, grey in rng.integers((0, 0, 8, 8, 0), (SIDE - 8, SIDE - 8, 36, 36, 256), (SHAPES, 5)):
        out[y : y + h, x : x + w] = grey
    at = np.linspace(0, GRID - 1, SIDE)
    low = np.minimum(at.astype(int), GRID - 2)
    part = at - low
    coarse = rng.uniform(-SHADES, SHADES, (GRID, GRID))
    rows = coarse[low] * (1 - part)[:, None] + coarse[low + 1] * part[:, None]
    shade = rows[:, low] * (1 - part) + rows[:, low + 1] * part
    return np.clip(out * (255 - 2 * SHADES) / 255 + SHADES + shade, 0, 255).astype(np.uint8)


def edited(pixels: np.ndarray, n: int) -> np.ndarray:
    """A crop of the picture, in other grey values."""
    rng = np.random.default_rng(abs(n))
    y, x = rng.integers(0, SIDE // 8, 2)
    part = pixels[y : y + SIDE * 7 // 8, x : x + SIDE * 7 // 8].astype(float)
    return np.clip(part * rng.uniform(0.75, 0.95) + rng.uniform(0, 12), 0, 255).astype(np.uint8)


def drawn(vectors: DataFrame, copy: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, image): the pictures of the vectors, or edited copies of them. A null vector is an empty one, a null key edits like 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [picture(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_pgm(edited(p, i or 0) if copy else p) for i, p in zip(ids, found, strict=True)], pa.binary())], ["id", "image"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id long, image binary")
