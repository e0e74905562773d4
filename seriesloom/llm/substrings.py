"""Removal of passages that documents share, with a count-min prefilter.

A window is WORDS consecutive words of one document. A word is removed if some
window covers it whose words also start, in the same order, in a document with
a smaller doc_id.

First pass: every task counts the anchors of its windows in a count-min sketch
of its own, the sketches are added up, and counters of two and more become one
bit each. A window's anchor is the least hash among its ANCHOR-word sequences:
equal windows have equal anchors, and neighbouring windows mostly share theirs,
so anchors are several times fewer than windows, and an anchor's count is never
below that of its windows. A sketch never underestimates either, so a repeated
window is never missed. The merged sketch is broadcast where 2 * 2**MAX_BITS
bits hold it. Beyond that it stays in parts, each for a share of all anchors:
tasks send their anchors to the parts, and a part answers with those estimated
to repeat, dealt to where the texts they come from are sent as well. Parts grow
in number with the input, not in size.

Second pass: windows estimated to repeat are grouped exactly. A task resolves
what it can by itself: of equal windows only those of its smallest doc_id are
sent on, so a passage that a third of all documents share sends one document
a task. They travel packed, dealt by hash to shards of a bounded mean size.
Windows are told apart by the first 128 bits of the SHA-256 of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from seriesloom.llm.text import as_bytes
from seriesloom.llm.words import word_pieces

WORDS, ANCHOR = 13, 6
#: Rows of the sketch; the largest logarithm of its width; bytes of text for a counter.
SKETCH_ROWS, MAX_BITS, BYTES_A_COUNTER = 2, 28, 8
#: Words hashed at once; anchors and windows held before they are sent on; bytes of text for a shard.
AT_ONCE, ANCHORS_HELD, WINDOWS_HELD, SHARD_BYTES = 300_000, 2_000_000, 1_000_000, 1 << 24
#: Rows of the scan, as a logarithm, whose texts go together to where answers about their anchors arrive; counters of a part of the sketch for an anchor, as a logarithm.
GROUP_BITS, SPARE_BITS = 12, 2
#: Shards at most: a task's windows are not spread over more of them than it has windows to spare.
MAX_SHARDS = 1 << 18
CHUNK_BITS = 16
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_FACTORS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _rolled(d: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hash of each n consecutive values."""
    out = d[: len(d) - n + 1].copy()
    for k in range(1, n):
        out *= factor
        out += d[k : len(d) - n + 1 + k]
    return out


class Run:
    """Windows of some documents, side by side."""

    def __init__(self, rows: list[int], starts: list[int], texts: list[list[bytes]], words: int, anchor: int):
        self.text = list(chain.from_iterable(texts))
        digests = [np.frombuffer(b"".join(map(xxh3_64_digest, t)), ">u8").astype(np.uint64) for t in texts]
        sizes = np.array([len(d) for d in digests])
        d = np.concatenate(digests)
        n = len(d) - words + 1
        self.words = words
        ends = np.cumsum(sizes)
        at = np.arange(n)
        self.row = np.repeat(rows, sizes)[:n]
        self.pos = (np.repeat(np.array(starts) - ends + sizes, sizes)[:n] + at).astype(np.int64)
        valid = np.repeat(ends, sizes)[:n] - at >= words
        grams = _mixed(_rolled(d, anchor, _FACTORS[1]))
        reach, least = 1, grams
        span = words - anchor + 1
        while reach < span:
            more = min(reach, span - reach)
            least = np.minimum(least[: len(least) - more], least[more:])
            reach += more
        first = valid.copy()
        first[1:] &= (least[1:] != least[:-1]) | (self.row[1:] != self.row[:-1]) | ~valid[:-1]  # two parts of a text may lie side by side
        self.valid, self.first = valid, first
        self.anchors = _mixed(least[first] + _U(1))

    def repeated(self, estimate) -> np.ndarray:
        """Indices of the windows whose anchor is estimated to occur twice."""
        if not len(self.anchors):
            return np.zeros(0, np.int64)
        found = estimate(self.anchors)
        run = np.cumsum(self.first) - 1
        return np.flatnonzero(self.valid & found[np.maximum(run, 0)])

    def digests(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the SHA-256 of each window's words."""
        text, words = self.text, self.words
        found = b"".join([sha256(b" ".join(text[i : i + words])).digest()[:16] for i in windows.tolist()])
        return tuple(np.frombuffer(found, "<u8").reshape(-1, 2).T.copy())


def _runs(texts: Iterable[pa.Scalar], words: int, anchor: int) -> Iterator[Run]:
    """All windows of the texts, a bounded number of words at a time; a long text comes in parts that overlap by words - 1."""
    rows, starts, held, n = [], [], [], 0
    for r, text in enumerate(texts):
        at, tail = 0, []
        for part in word_pieces(text.as_py()):
            for k in range(0, len(part), AT_ONCE):
                some = tail + part[k : k + AT_ONCE]
                begin = at - len(tail)
                at = begin + len(some)
                tail = some[-(words - 1) :] if words > 1 else []
                if len(some) >= words:
                    rows.append(r)
                    starts.append(begin)
                    held.append(some)
                    n += len(some)
                if n >= AT_ONCE:
                    yield Run(rows, starts, held, words, anchor)
                    rows, starts, held, n = [], [], [], 0
    if held:
        yield Run(rows, starts, held, words, anchor)


def _places(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """An anchor's counter in each row of the sketch: different bits of it."""
    return [(anchors >> _U(64 - bits)).astype(np.int64), (anchors * _FACTORS[0] >> _U(64 - bits)).astype(np.int64)]


def _sketch_parts(batches: Iterator[pa.RecordBatch], bits: int, words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """This task's sketch: for each chunk of counters the low bits of those at one, and of those at two or more."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        held.clear()
        keys, ones, twos = [], [], []
        for row, place in enumerate(_places(anchors, bits)):
            place.sort()
            new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            many = np.diff(np.append(new, len(place))) > 1
            place = place[new]
            bounds = np.concatenate(([0], np.flatnonzero(place[1:] >> CHUNK_BITS != place[:-1] >> CHUNK_BITS) + 1, [len(place)]))
            low = (place & ((1 << CHUNK_BITS) - 1)).astype("<u2")
            for a, b in zip(bounds, bounds[1:], strict=False):
                keys.append(row << (MAX_BITS - CHUNK_BITS) | int(place[a] >> CHUNK_BITS))
                ones.append(low[a:b][~many[a:b]].tobytes())
                twos.append(low[a:b][many[a:b]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["chunk", "ones", "twos"])

    n = 0
    for batch in batches:
        for run in _runs(batch.column(0), words, anchor):
            held.append(run.anchors)
            n += len(run.anchors)
            if n >= ANCHORS_HELD:
                yield from flush()
                n = 0
    if n:
        yield from flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the tasks' counters (a counter stops at two) and keep a bit for each that reached two."""
    counters: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = counters.get(key)
            if c is None:
                c = counters[key] = np.zeros(1 << CHUNK_BITS, np.uint8)
            one = np.frombuffer(one, "<u2")
            c[one] = np.minimum(c[one] + 1, 2)
            c[np.frombuffer(two, "<u2")] = 2
    for key, c in counters.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(c > 1, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])


def sketch_bits(n_bytes: int) -> int:
    """The logarithm of a sketch's width for so many bytes of text."""
    return max(CHUNK_BITS, (n_bytes // BYTES_A_COUNTER).bit_length())


def repeat_sketch(texts: DataFrame, bits: int, words: int = WORDS, anchor: int = ANCHOR) -> np.ndarray:
    """The merged sketch of one binary column; sketch[row] has a bit for each of 2**bits counters, bits <= MAX_BITS."""
    parts = texts.mapInArrow(lambda it: _sketch_parts(it, bits, words, anchor), "chunk int, ones binary, twos binary")
    sketch = np.zeros((SKETCH_ROWS, 1 << (bits - 3)), np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for r in parts.repartition("chunk").mapInArrow(_merged, "chunk int, bits binary").toLocalIterator():  # at most 2 * 2**MAX_BITS bits in all
        at = (r.chunk & ((1 << (MAX_BITS - CHUNK_BITS)) - 1)) * size
        sketch[r.chunk >> (MAX_BITS - CHUNK_BITS), at : at + size] = np.frombuffer(r.bits, np.uint8)
    return sketch


def shards_for(n_bytes: int, size: int) -> int:
    return min(MAX_SHARDS, max(8, n_bytes // size))


def row_bucket(row: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each row number; their leading bits are the partition's, so they are mixed first."""
    return ((np.asarray(row).astype(np.uint64) * _FACTORS[0] >> _U(32)) % _U(n)).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(c.tobytes() for c in columns))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): in this order equal windows are adjacent, and `later` tells which have a smaller doc_id among them."""
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    least = np.repeat(d[new], np.diff(np.append(new, len(d))))
    return order, d > least


def _whole(batches: Iterator[pa.RecordBatch], sketch: Broadcast, bits: int) -> Iterator[tuple]:
    """Texts (row_no, doc_id, text) with the broadcast sketch's estimate."""
    table = sketch.value

    def estimate(anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for row, place in enumerate(_places(anchors, bits)):
            out &= (table[row][place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out

    for batch in batches:
        number, doc_id = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield number, doc_id, batch.column(2), estimate


def _groups(row: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each row for the exchange of anchors: rows that lie together in the scan stay together."""
    return row_bucket(np.asarray(row).astype(np.int64) >> GROUP_BITS, n)


def _asking(batches: Iterator[pa.RecordBatch], shards: int, words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Distinct (anchor, bucket) of this task, with whether it was seen twice there, packed by the part that counts the anchor."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        anchors, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        part = anchors % _U(shards)
        order = np.lexsort((bucket, anchors, part))
        anchors, bucket, part = anchors[order], bucket[order], part[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (bucket[1:] != bucket[:-1]))))
        many = (np.diff(np.append(new, len(anchors))) > 1).astype(np.uint8)
        anchors, bucket, part = anchors[new], bucket[new].astype("<u4"), part[new]
        bounds = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        data = [_packed(anchors[a:b], bucket[a:b], many[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    n = 0
    for batch in batches:
        number = batch.column(0).to_numpy(zero_copy_only=False)
        for run in _runs(batch.column(1), words, anchor):
            held.append((run.anchors, _groups(number[run.row[run.first]], shards)))
            n += len(run.anchors)
            if n >= ANCHORS_HELD:
                yield from flush()
                n = 0
    if n:
        yield from flush()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, data): the anchors that a part of the sketch estimates at two or more, for each bucket that has them."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        anchors, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(bucket, kind="stable")
        anchors, bucket = anchors[order], bucket[order]
        bounds = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        data = [_packed(anchors[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])

    n = 0
    for _, rows in _by_key(batches):
        anchors, bucket, many = (np.concatenate(x) for x in zip(*(_unpacked(r[0], "<u8", "<u4", "u1") for r in rows), strict=True))
        bits = len(anchors).bit_length() + SPARE_BITS
        found = np.ones(len(anchors), bool)
        for place in _places(anchors, bits):
            found &= np.bincount(place, 1 + many, 1 << bits)[place] > 1
        held.append((anchors[found], bucket[found]))
        n += int(found.sum())
        if n >= ANCHORS_HELD:
            yield from flush()
            n = 0
    if n:
        yield from flush()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Texts with the estimate that the answers to their bucket give; rows come sorted by (bucket, row_no), answers have row_no -1."""
    expand = zstandard.ZstdDecompressor().decompress
    now, answers, known = None, [], np.zeros(0, np.uint64)
    for batch in batches:
        bucket, number, doc_id = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        data = batch.column(3)
        bounds = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | ((number[1:] < 0) != (number[:-1] < 0)), [True]))) if batch.num_rows else []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if bucket[a] != now:
                now, answers, known = bucket[a], [], np.zeros(0, np.uint64)
            if number[a] < 0:
                answers += [_unpacked(data[k].as_py(), "<u8")[0] for k in range(a, b)]
                continue
            if answers:
                known, answers = np.unique(np.concatenate(answers)), []

            def estimate(anchors: np.ndarray, known: np.ndarray = known) -> np.ndarray:
                return known[np.minimum(np.searchsorted(known, anchors), len(known) - 1)] == anchors if len(known) else np.zeros(len(anchors), bool)

            yield number[a:b], doc_id[a:b], (pa.scalar(expand(data[k].as_py())) for k in range(a, b)), estimate


def _sent_texts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in _compressed(batches):
        bucket = _groups(batch.column(0).to_numpy(), shards)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *batch.columns], ["bucket", "row_no", "doc_id", "data"])


def _repeating(stretches: Iterator[tuple[np.ndarray, np.ndarray, Iterable[pa.Scalar], Callable]], shards: int, words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Windows estimated to repeat, packed by shard; and those known to repeat from this task alone."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h1, h2, doc, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, later = _later(h1, h2, doc)
        known, sent = np.sort(order[later]), np.sort(order[~later])
        keys, open_, sure = [], [], []
        shard = (h1 % _U(shards)).astype(np.int64)[sent]
        sent = sent[np.argsort(shard, kind="stable")]
        shard.sort()
        own = row_bucket(row[known], shards)
        known = known[np.argsort(own, kind="stable")]
        own.sort()
        for s in np.union1d(shard, own):
            x = sent[slice(*np.searchsorted(shard, [s, s + 1]))]
            y = known[slice(*np.searchsorted(own, [s, s + 1]))]
            keys.append(s)
            open_.append(_packed(h1[x], h2[x], doc[x], row[x], pos[x]))
            sure.append(_packed(row[y], pos[y]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(open_, pa.binary()), pa.array(sure, pa.binary())], ["shard", "open", "sure"])

    n = 0
    for number, doc_id, texts, estimate in stretches:
        for run in _runs(texts, words, anchor):
            x = run.repeated(estimate)
            if len(x):
                held.append((*run.digests(x), doc_id[run.row[x]], number[run.row[x]], run.pos[x].astype(np.uint32)))
                n += len(x)
            if n >= WINDOWS_HELD:
                yield from flush()
                n = 0
    if n:
        yield from flush()


def _candidates(batches: Iterator[pa.RecordBatch], sketch: Broadcast, bits: int, shards: int, words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    return _repeating(_whole(batches, sketch, bits), shards, words, anchor)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(key, rows) of runs of equal keys in the first column; rows come sorted by it."""
    key, rows = None, []
    for batch in batches:
        for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(rest)
    if rows:
        yield key, rows


def _resolved(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Group each shard's windows exactly; what is to be removed goes on packed by the bucket of its row."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = row_bucket(row, buckets)
        order = np.lexsort((pos, row, bucket))
        row, pos, bucket = row[order], pos[order], bucket[order]
        bounds = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        data = [_packed(row[a:b], pos[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    n = 0
    for _, rows in _by_key(batches):
        h1, h2, doc, row, pos = (np.concatenate(x) for x in zip(*(_unpacked(r[0], "<u8", "<u8", "<i8", "<i8", "<u4") for r in rows), strict=True))
        order, later = _later(h1, h2, doc) if len(h1) else (np.zeros(0, np.int64), np.zeros(0, bool))
        found = [(row[order[later]], pos[order[later]]), *(_unpacked(r[1], "<i8", "<u4") for r in rows)]
        for f in found:
            if len(f[0]):
                held.append(tuple(f))
                n += len(f[0])
        if n >= WINDOWS_HELD:
            yield from flush()
            n = 0
    if n:
        yield from flush()


def _ranges(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(row, ranges): the covered words of each row as sorted, disjoint [start, end) pairs."""
    for _, rows in _by_key(batches):
        row, pos = (np.concatenate(x) for x in zip(*(_unpacked(r[0], "<i8", "<u4") for r in rows), strict=True))
        order = np.lexsort((pos, row))
        row, pos = row[order], pos[order].astype(np.int64)
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + words)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        pairs = np.stack([pos[first], pos[last] + words], axis=1).astype("<i8")
        owner = row[first]
        bounds = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]))
        data = [pairs[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(owner[bounds[:-1]]), pa.array(data, pa.binary())], ["row_no", "ranges"])


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(row_no, ranges) of the rows of `docs` with words to remove; row_no is the row's number in the scan."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    shards = shards_for(n_bytes, SHARD_BYTES)
    bits = sketch_bits(n_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("doc_id"), as_bytes(F.col(text)).alias("text"))
    kinds = "shard int, open binary, sure binary"
    if bits <= MAX_BITS:
        sketch = docs.sparkSession.sparkContext.broadcast(repeat_sketch(rows.select("text"), bits, words, anchor))  # 2 * 2**bits bits
        found = rows.mapInArrow(lambda it: _candidates(it, sketch, bits, shards, words, anchor), kinds)
    else:
        asked = rows.select("row_no", "text").mapInArrow(lambda it: _asking(it, shards, words, anchor), "part int, data binary")
        answers = asked.repartition("part").sortWithinPartitions("part").mapInArrow(_answers, "bucket int, data binary")
        sent = rows.mapInArrow(lambda it: _sent_texts(it, shards), "bucket int, row_no long, doc_id long, data binary")
        both = sent.unionByName(answers.select("bucket", F.lit(-1).cast("long").alias("row_no"), F.lit(0).cast("long").alias("doc_id"), "data"))
        met = both.repartition("bucket").sortWithinPartitions("bucket", "row_no")
        found = met.mapInArrow(lambda it: _repeating(_met(it), shards, words, anchor), kinds)
    solved = found.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _resolved(it, shards), "bucket int, data binary")
    return solved.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _ranges(it, words), "row_no long, ranges binary")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze(t.as_py()) for t in batch.column(2)], pa.binary())], ["row_no", "doc_id", "text"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        n_words, n_removed, kept_text = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            words = [w for part in word_pieces(expand(text.as_py())) for w in part]
            n_words.append(len(words))
            if ranges.is_valid:
                keep, at = [], 0
                for a, b in np.frombuffer(ranges.as_py(), "<i8").reshape(-1, 2).tolist():
                    keep += words[at:a]
                    at = b
                words = keep + words[at:]
            n_removed.append(n_words[-1] - len(words))
            kept_text.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary, UTF-8): one row per input row.

    kept: the words that stay, joined by one space. Words are taken as they
    are; a null text has none. Windows are judged on the input. A null doc_id
    counts as 2**63 - 1, the largest there is; rows with equal doc_ids do not remove each
    other's words. A text with fewer words than a window loses nothing unless
    it has none. `docs` must be a stored table: it is read more than once.
    """
    ranges = repeated_ranges(docs, doc_id, text, words, anchor)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).cast("long").alias("doc_id"), as_bytes(F.col(text)).alias("text"))
    packed = rows.mapInArrow(_compressed, "row_no long, doc_id long, text binary")
    joined = packed.join(ranges, "row_no", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """remove_repeats with the kept text's digest in its place."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], words: int = WORDS) -> list[tuple]:
    """The same result on a small list, by a dictionary of all windows."""
    split = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    least: dict = {}
    for i, w in split:
        for k in range(len(w) - words + 1):
            key = tuple(w[k : k + words])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, w), (own, _) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - words + 1):
            if least[tuple(w[k : k + words])] < i:
                gone[k : k + words] = [True] * words
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((own, len(w), sum(gone), sha256(kept).hexdigest()))
    return out
