"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has 64 bits: bit k is 1 if over half of its shingles'
XXH64 values have bit k set. Two fingerprints link if at most `radius` bits
differ. Every link is found: with radius + c disjoint bit blocks, two linked
fingerprints agree on some c whole blocks, so they meet in one of the tables
keyed by c blocks; c grows with the number of distinct fingerprints, so that a
table's buckets stay small at any size.

Inside a bucket, 64 fingerprints form one word of each bit plane. A query
fingerprint is compared with whole words at once: three planes at a time go
through a carry-save adder into bitwise counters, and a word is abandoned once
all of its 64 distances exceed the radius.

A bucket with more than TILE fingerprints is dealt out as pairs of chunks, each
a small task of its own. A task emits a spanning forest of its links, never all
pairs. Equal fingerprints are one node; copies are not compared.

near.py compares with the same planes at a wider radius, and then in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.components import connected_components
from seriesloom.llm.text import as_bytes
from seriesloom.runtime import cut

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Largest chunk of a bucket; mean bucket size of a table of random fingerprints at most; pairs (query, word) compared at once.
TILE, BUCKET, SLICE = 8192, 2048, 1 << 16
#: Planes added between two looks for words to abandon; shingles counted at once.
STRIDE, SHINGLES_AT_ONCE = 12, 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned integer; no words: 0."""
    words = text.lower().split()  # of bytes: only A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, SHINGLES_AT_ONCE):
        part = [digest(joined[i:j], SEED) for i, j in zip(starts[k : k + SHINGLES_AT_ONCE], ends[k : k + SHINGLES_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a long. Null and empty texts: 0."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(F.col(text)).alias("text")).mapInArrow(lambda it: _fingerprints(it, shingle_words), "doc_id long, fp long")


def bit_blocks(n: int, radius: int) -> list[int]:
    """Key masks (signed) so that two values within the radius agree under one of them, with at most about BUCKET random values a key."""
    for c in range(1, 5):
        bounds = np.linspace(0, 64, radius + c + 1).round().astype(int)
        masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
        keys = [sum(group) for group in combinations(masks, c)]
        if n >> min(k.bit_count() for k in keys) <= BUCKET:
            break
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def _add(counters: list[np.ndarray], over: np.ndarray, x: np.ndarray, level: int) -> None:
    """Ripple x, worth 2**level a lane, into the counters; over: lanes whose count ran out of bits."""
    for c in counters[level:]:
        carry = c & x
        c ^= x
        x = carry
    over |= x


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    more, equal = np.zeros_like(over), ~np.zeros_like(over)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return over | more


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit i of plane[k][w] is bit k of value 64 w + i. The length is a multiple of 64."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def near_words(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, dead: np.ndarray, radius: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For the pairs (query value, word number): indices of the pairs with a lane within the radius, and these lanes.

    dead: lanes not to report, one word a pair. skip: a mask of bits known to be equal.
    """
    order = [k for k in range(64) if not skip >> k & 1]
    size = int(radius).bit_length()
    alive = np.arange(len(queries))
    counters, over = [np.zeros(len(queries), np.uint64) for _ in range(size)], dead.copy()
    for at in range(0, len(order), STRIDE):
        part = order[at : at + STRIDE]
        for three in range(0, len(part), 3):
            x = [planes[k][words] ^ -(queries >> np.uint64(k) & np.uint64(1)) for k in part[three : three + 3]]
            if len(x) == 3:
                half = x[0] ^ x[1]
                carry = (x[0] & x[1]) | (half & x[2])
                _add(counters, over, half ^ x[2], 0)
                _add(counters, over, carry, 1)
            else:
                for y in x:
                    _add(counters, over, y, 0)
        out = _exceeds(counters, over, radius)
        stay = out != ~np.uint64(0)
        if not stay.all():
            alive, queries, words, over = alive[stay], queries[stay], words[stay], over[stay]
            counters = [c[stay] for c in counters]
        if not len(alive):
            break
    return alive, ~_exceeds(counters, over, radius)


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of u and v in place; a root is its tree's smallest number."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def linked(groups: list[np.ndarray], radius: int, skip: int = 0) -> Iterator[np.ndarray]:
    """For each group of distinct values: parents of a spanning forest of its links within the radius."""
    sizes = np.array([len(g) for g in groups])
    n_words = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(n_words)))
    padded = np.zeros(first[-1] * 64, np.uint64)
    taken = np.zeros(first[-1] * 64, bool)
    for g, w in zip(groups, first, strict=False):
        padded[w * 64 : w * 64 + len(g)], taken[w * 64 : w * 64 + len(g)] = g, True
    planes = bit_planes(padded)
    empty = ~np.packbits(taken.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    at = np.flatnonzero(taken)
    own = at >> 6
    last = np.repeat(first[1:], sizes)
    reach = last - own  # words from its own to the group's last
    parent = np.arange(len(taken))
    ends = np.cumsum(reach)
    k = 0
    while k < len(at):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLICE, "right")))
        r = reach[k:stop]
        member = np.repeat(np.arange(k, stop), r)
        words = own[member] + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
        lane = (at[member] & 63).astype(np.uint64)
        before = np.where(words == own[member], (np.uint64(2) << lane) - np.uint64(1), np.uint64(0))  # itself and earlier ones
        alive, lanes = near_words(padded[at[member]], words, planes, empty[words] | before, radius, skip)
        if len(alive):
            hit, bit = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _forest(parent, at[member[alive[hit]]], words[alive[hit]] * 64 + bit)
        k = stop
    for g, w in zip(groups, first, strict=False):
        yield parent[w * 64 : w * 64 + len(g)] - w * 64


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal (mask, key, chunk, other); rows come sorted by these."""
    rest: list[np.ndarray] | None = None

    def flush(columns: list[np.ndarray], whole: bool) -> tuple[list[np.ndarray] | None, pa.RecordBatch | None]:
        *key, fp, node = columns
        new = np.zeros(len(fp), bool)
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(new)))
        stop = len(fp) if whole else bounds[-1]
        a, b = [], []
        bounds = np.append(bounds[bounds < stop], stop)
        masks = key[0][bounds[:-1]] if stop else []
        for mask in np.unique(masks):
            runs = [(i, j) for i, j, m in zip(bounds, bounds[1:], masks, strict=False) if m == mask and j - i > 1]
            if runs:
                for (i, j), up in zip(runs, linked([fp[i:j].view(np.uint64) for i, j in runs], radius, int(mask) % (1 << 64)), strict=True):
                    x = np.flatnonzero(up != np.arange(j - i))
                    a.append(node[i:j][x])
                    b.append(node[i:j][up[x]])
        found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"]) if a else None
        return (None if whole else [c[stop:] for c in columns]), found

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if len(rest[0]) >= 4 * TILE:
            rest, found = flush(rest, False)
            if found is not None:
                yield found
    if rest is not None and len(rest[0]):
        _, found = flush(rest, True)
        if found is not None:
            yield found


def hamming_links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of `nodes` (fp, node; fp distinct) at most `radius` bits apart, in one table or another."""
    masks = F.array(*[F.lit(m).cast("long") for m in bit_blocks(n, radius)])
    rows = nodes.select("fp", "node", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    large = rows.groupBy("mask", "key").count().where(F.col("count") > TILE).select("mask", "key", F.ceil(F.col("count") / TILE).cast("int").alias("chunks"))
    rows = rows.join(large, ["mask", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    rows = rows.select("fp", "node", "mask", "key", "chunk", F.explode(others).alias("other"))
    rows = rows.select("mask", "key", F.least("chunk", "other").alias("chunk"), F.greatest("chunk", "other").alias("other"), "fp", "node")
    run = ["mask", "key", "chunk", "other"]
    return rows.repartition(*run).sortWithinPartitions(*run).mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    component_id is the smallest doc_id reachable over links, its own included.
    Words are split at ASCII white space after lower-casing A-Z; a text with
    fewer words than a shingle is one shingle, a text without words (or null)
    has fingerprint 0 and is linked like any other. Repeated doc_ids stay
    repeated rows. A row with a null doc_id links nothing and gets the
    component of its fingerprint, null if no other row has that fingerprint.
    """
    prints = cut(fingerprints(docs, doc_id, text, shingle_words))
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = hamming_links(nodes, nodes.count(), radius)
    found = connected_components(links)
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
