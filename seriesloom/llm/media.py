"""Cropped or edited copies of images by local descriptors.

Images of equal bytes are one class, known by a digest, and a task describes
each digest once. Query descriptors and all others meet in TABLES Hamming
tables, each keyed by KEY_BITS bits drawn at random: descriptors that agree on
one table's bits are compared bit by bit. No key finds every pair within
DISTANCE; tests/llm/test_media.py measures the share against brute force. An
image matches if at least INLIERS corners agree on one scale, turn and shift.

The tables of CHUNK query descriptors at a time are sent to all tasks, so that
neither images nor descriptors are shuffled; a pass over the images is made for
each chunk. A chunk holds all corners of its query images and a batch all of its
images, so votes are counted where the pairs are found and only matches leave a
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.images import decode_pgm, describe
from seriesloom.runtime import cut

#: Bits of a key; tables; most differing bits of two descriptors; corners that must agree.
KEY_BITS, TABLES, DISTANCE, INLIERS = 20, 32, 40, 8
#: Query descriptors sent to the tasks at once; descriptors of a task looked up at once; pairs compared at once.
CHUNK, AT_ONCE, PAIRS = 1 << 17, 1 << 14, 1 << 18
#: Width of a vote's bin: pixels, doublings, turns.
SHIFT, DOUBLING, TURN = 6.0, 0.6, 0.5
ROW = "digest binary, corner int, x float, y float, scale float, angle float, d0 long, d1 long, d2 long, d3 long"
_NAMES = [f.split()[0] for f in ROW.split(", ")]
#: The bits of each table's key, from a fixed seed.
_CHOSEN = np.stack([np.random.default_rng((2025, t)).permutation(256)[:KEY_BITS] for t in range(TABLES)])


def _keys(descriptors: np.ndarray) -> np.ndarray:
    """(TABLES, corners): each table's KEY_BITS bits of the descriptors."""
    bits = np.unpackbits(descriptors.view(np.uint8), axis=1, bitorder="little").T.astype(np.uint32)
    return np.stack([reduce(lambda key, k: key << np.uint32(1) | bits[k], chosen, np.zeros(len(descriptors), np.uint32)) for chosen in _CHOSEN])


def near_pairs(queries: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], descriptors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, descriptor): the numbers of the pairs that meet in a table and differ in at most DISTANCE bits, each once."""
    found = [np.zeros(0, np.int64)]
    for (order, ordered), keys in zip(tables, _keys(descriptors), strict=True):
        low = np.searchsorted(ordered, keys, "left")
        many = np.searchsorted(ordered, keys, "right") - low
        ends = np.cumsum(many)
        for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(a, min(a + PAIRS, int(ends[-1])))
            own = np.searchsorted(ends, pair, "right")
            query = order[low[own] + pair - (ends[own] - many[own])]
            apart = np.bitwise_count(queries[query] ^ descriptors[own]).sum(axis=1, dtype=np.int64)
            near = apart <= DISTANCE
            found.append(query[near] * len(descriptors) + own[near])
    both = np.unique(np.concatenate(found))
    return both // max(1, len(descriptors)), both % max(1, len(descriptors))


def tables_of(queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table, the queries' numbers by key and their keys, ascending."""
    return [(order := np.argsort(keys, kind="stable"), keys[order]) for keys in _keys(queries)]


def digest_of(image: bytes | None) -> bytes:
    """16 bytes of SHA-256."""
    return sha256(image or b"").digest()[:16]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    out: list[list] = [[] for _ in _NAMES]

    def flush() -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) if k else pa.array([d for part in c for d in part], pa.binary()) for k, c in enumerate(out)]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, _NAMES)

    held = 0
    for batch in batches:
        for data in batch.column(0):
            own = digest_of(data.as_py())
            if own in seen:
                continue
            seen.add(own)
            pixels = decode_pgm(data.as_py())
            if pixels is None:
                continue
            places, descriptors = describe(pixels)
            parts = ([own] * len(places), np.arange(len(places), dtype=np.int32), *places.T, *descriptors.view(np.int64).T)
            for column, part in zip(out, parts, strict=True):
                column.append(part)
            held += len(places)
            if held >= AT_ONCE:
                yield flush()
                held = 0
    if held:
        yield flush()


def _descriptors(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(f"d{k}").to_numpy() for k in range(4)], 1).view(np.uint64)


def votes(asked: pa.Table, there: pa.RecordBatch, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of asked, a row of there, inliers): a row of each query image and image of which at least INLIERS pairs (q, own) agree.

    Pairs agree on the doublings, the turn and where the query's centre would
    lie, in one of four grids of bins half a bin apart; a query's corner counts
    once a bin.
    """
    codes = [np.unique(t.column("digest").to_numpy(zero_copy_only=False), return_inverse=True)[1] for t in (asked, there)]
    image = codes[0][q] * (1 + codes[1].max(initial=0)) + codes[1][own]
    _, first, image, many = np.unique(image, return_index=True, return_inverse=True, return_counts=True)
    heads = q[first], own[first]
    some = many[image] >= INLIERS  # fewer pairs cannot be INLIERS votes
    q, own, image = q[some], own[some], image[some]
    (x0, y0, scale0, angle0), (x, y, scale, angle) = ([t.column(c).to_numpy().astype(np.float64)[at] for c in ("x", "y", "scale", "angle")] for t, at in ((asked, q), (there, own)))
    turn = np.arctan2(np.sin(angle - angle0), np.cos(angle - angle0))
    factor = scale / scale0
    # Where the query's centre would lie: the shift, once turned and scaled.
    sx = x - factor * (np.cos(turn) * x0 - np.sin(turn) * y0)
    sy = y - factor * (np.sin(turn) * x0 + np.cos(turn) * y0)
    doublings, turns = np.round(np.log2(factor) / DOUBLING).astype(np.int64), np.round(turn / TURN).astype(np.int64) % round(2 * np.pi / TURN)
    corner = asked.column("corner").to_numpy()[q]
    best = np.zeros(len(first), np.int64)
    for ox in (0.0, 0.5):
        for oy in (0.0, 0.5):
            rows = np.stack([image, doublings, turns, np.floor(sx / SHIFT + ox).astype(np.int64), np.floor(sy / SHIFT + oy).astype(np.int64), corner])
            rows = rows[:, np.lexsort(rows[::-1])]
            rows = rows[:, np.concatenate((np.ones(min(1, rows.shape[1]), bool), (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
            start = np.flatnonzero(np.concatenate((np.ones(min(1, rows.shape[1]), bool), (rows[:5, 1:] != rows[:5, :-1]).any(axis=0))))
            np.maximum.at(best, rows[0, start], np.diff(start, append=rows.shape[1]))
    found = best >= INLIERS
    return heads[0][found], heads[1][found], best[found]


def _matched(batches: Iterator[pa.RecordBatch], chunk: Broadcast) -> Iterator[pa.RecordBatch]:
    """(query, digest, inliers) of the chunk's query images and this task's images; each image is in one batch as a whole."""
    asked: pa.Table = chunk.value
    queries = _descriptors(asked)
    tables = tables_of(queries)
    for batch in _described(batches):
        q, own, inliers = votes(asked, batch, *near_pairs(queries, tables, _descriptors(batch)))
        if len(q):
            yield pa.RecordBatch.from_arrays([asked.column("digest").take(pa.array(q)).combine_chunks(), batch.column("digest").take(pa.array(own)), pa.array(inliers)], ["query", "digest", "inliers"])


def image_matches(queries: DataFrame, images: DataFrame) -> DataFrame:
    """(query, digest, inliers) of the pairs of image digests that show the same picture; both tables have an `image` column of bytes.

    Data that is no readable image has no descriptors and matches nothing.
    """
    asked = cut(queries.select("image").mapInArrow(_described, ROW).dropDuplicates(["digest", "corner"]))
    chunks = max(1, -(-asked.count() // CHUNK))
    parts = []
    for k in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("digest"), F.lit(chunks)) == k).toArrow()  # about CHUNK rows of 68 bytes
        shared = images.sparkSession.sparkContext.broadcast(rows)
        parts.append(cut(images.select("image").mapInArrow(lambda it, shared=shared: _matched(it, shared), "query binary, digest binary, inliers long")))
        shared.unpersist()
    return reduce(DataFrame.unionByName, parts).groupBy("query", "digest").agg(F.max("inliers").alias("inliers"))  # tasks may share a digest


def image_classes(images: DataFrame) -> DataFrame:
    """(id, digest, class_id): the smallest id with the same bytes; a null image is a class of its own id."""
    rows = images.select("id", F.substring(F.unhex(F.sha2("image", 256)), 1, 16).alias("digest"))
    least = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"))
    return rows.join(least, "digest", "left").select("id", "digest", F.coalesce("class_id", "id").alias("class_id"))


def find_copies(images: DataFrame, queries: DataFrame) -> DataFrame:
    """id, class_id, asked, match, inliers: a row for each image, and one more for each further class that it matches.

    images and queries: (id long, image binary). Images of equal bytes share
    class_id, their smallest id. An id among the queries has asked = true, and
    a row for every class whose picture its query image shows: `match`, the
    class's smallest id, and the corners that agree; both are null if there is
    none, and for other ids. Of several query images of one id, all count. A
    null id is an image like any other, but no query; a class of null ids only
    has a null class_id, and a match with it has inliers alone. Repeated ids
    are rows of their own, an empty table gives an empty result.
    """
    classes = cut(image_classes(images))
    heads = classes.where("digest is not null").groupBy("digest").agg(F.min("class_id").alias("match"))
    asked = cut(queries.where("id is not null").select(F.col("id").alias("query"), F.substring(F.unhex(F.sha2("image", 256)), 1, 16).alias("q_digest")).distinct())
    found = image_matches(queries, images).withColumnRenamed("query", "q_digest").join(heads, "digest")
    found = asked.join(found, "q_digest").groupBy("query", "match").agg(F.max("inliers").alias("inliers"))
    found = asked.select("query").distinct().join(found, "query", "left")
    out = classes.join(found, F.col("id") == F.col("query"), "left")
    return out.select("id", "class_id", F.col("query").isNotNull().alias("asked"), "match", "inliers")
