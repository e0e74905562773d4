"""The binary container of one blob: header, names, index, shared timestamps, columns.

Numeric blobs have a timestamp, a value and a tag section; text blobs have one
section of interleaved rows. All sections follow each other without padding.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from xxhash import xxh64_intdigest

from seriesloom.codecs import alp, block, timestamps, values
from seriesloom.codecs.bits import get_varint, put_varint
from seriesloom.errors import SeriesError

#: Fixed values of the format: encoding ids, option bits and magic numbers.
RAW, DELTA, GORILLA, CHIMP, DELTA_PACKED, ALP = 1, 2, 3, 4, 5, 6
NAMES = {RAW: "Raw", DELTA: "Delta", GORILLA: "Gorilla", CHIMP: "Chimp", DELTA_PACKED: "DeltaPacked", ALP: "ALP"}
TAGS, BIG_ENDIAN, HAS_NAMES, SHARED, MAGIC = 0x1, 0x2, 0x4, 0x8, 0xFFF0
NUMERIC_V1, NUMERIC_V2, NUMERIC_V2_WIDE, TEXT_V1 = 0xEA10, 0xEA20, 0xEA30, 0xEB10
HEADER, ENTRY, WIDE_ENTRY, MAX_COMPACT, MAX_METRICS, MAX_TEXT = 32, 16, 32, 65_535, 65_536, 255
MAX_BLOB = (1 << 32) - 1


@dataclass(frozen=True)
class Config:
    """How a blob is written. The facade's default: delta timestamps, gorilla values, no block compression."""

    ts: int = DELTA
    val: int = GORILLA
    ts_block: int = block.NONE
    val_block: int = block.NONE
    tags: bool = False
    big_endian: bool = False
    v2: bool = False
    shared: bool = False

    def __post_init__(self):
        if self.ts not in (RAW, DELTA, DELTA_PACKED) or self.val not in (RAW, GORILLA, CHIMP, ALP):
            raise SeriesError("UnsupportedEncoding")
        for kind in (self.ts_block, self.val_block):
            if kind not in block.NAMES:
                raise SeriesError("UnsupportedCompression")
        if self.shared and not self.v2:
            object.__setattr__(self, "v2", True)  # sharing needs the second layout


@dataclass(frozen=True)
class TextConfig:
    ts: int = DELTA
    block: int = block.ZSTD
    tags: bool = False
    big_endian: bool = False

    def __post_init__(self):
        if self.ts not in (RAW, DELTA):
            raise SeriesError("UnsupportedEncoding")


@dataclass
class Metric:
    """A metric's columns in a blob. ident is unsigned; tags may be none."""

    ident: int
    ts: np.ndarray
    val: np.ndarray | list[str]
    tags: list[str] | None = None
    name: str | None = None


@dataclass
class Packed:
    """A metric's columns as bytes; of a text blob val has its rows."""

    ident: int
    name: str | None
    n: int
    ts: bytes
    val: bytes
    tag: bytes = b""
    tagged: bool = False


@dataclass
class Blob:
    kind: str
    start: int
    metrics: list[Metric]
    ts_encoding: int
    val_encoding: int
    layout: str
    has_tags: bool
    has_names: bool
    big_endian: bool
    size: int
    extra: dict = field(default_factory=dict)


def _put_names(names: list[str], mark: str) -> bytes:
    if len(names) > MAX_COMPACT:
        raise SeriesError("InvalidMetricNamesCount")
    return struct.pack(mark + "H", len(names)) + b"".join(struct.pack(mark + "H", len(n)) + n for n in (s.encode() for s in names))


def _get_names(data: bytes, at: int, count: int, mark: str) -> tuple[list[str], int]:
    try:
        (n,) = struct.unpack_from(mark + "H", data, at)
        at += 2
        out = []
        for _ in range(n):
            (size,) = struct.unpack_from(mark + "H", data, at)
            if at + 2 + size > len(data):
                raise SeriesError("InvalidMetricNamesPayload")
            out.append(data[at + 2 : at + 2 + size].decode())
            at += 2 + size
    except (struct.error, UnicodeDecodeError) as e:
        raise SeriesError("InvalidMetricNamesPayload") from e
    if n != count:
        raise SeriesError("InvalidMetricNamesCount")
    return out, at


def _put_strings(items: list[str]) -> bytes:
    return b"".join(put_varint(len(r)) + r for r in (s.encode() for s in items))


def _get_strings(data: bytes, count: int) -> list[str]:
    out, at = [], 0
    for _ in range(count):
        size, at = get_varint(data, at)
        stop = at + size
        if stop > len(data):
            raise SeriesError("InvalidTagPayloadOffset")
        out.append(data[at:stop].decode())
        at = stop
    return out


def timestamp_bytes(ts: np.ndarray, kind: int, little: bool = True) -> bytes:
    return timestamps.encode_raw(ts, little) if kind == RAW else timestamps.encode_delta(ts) if kind == DELTA else timestamps.encode_packed(ts)


def _ts_from(data: bytes, n: int, kind: int, little: bool) -> np.ndarray:
    return timestamps.decode_raw(data, n, little) if kind == RAW else timestamps.decode_delta(data, n) if kind == DELTA else timestamps.decode_packed(data, n)


def value_bytes(v: np.ndarray, kind: int, little: bool = True) -> bytes:
    if kind == RAW:
        return values.encode_raw(v, little)
    return values.encode_gorilla(v) if kind == GORILLA else values.encode_chimp(v) if kind == CHIMP else alp.encode(v, little)


def value_from(data: bytes, n: int, kind: int, little: bool = True) -> np.ndarray:
    if kind == RAW:
        return values.decode_raw(data, n, little)
    return values.decode_gorilla(data, n) if kind == GORILLA else values.decode_chimp(data, n) if kind == CHIMP else alp.decode(data, n, little)


def _check(metrics: list[Metric] | list[Packed]) -> bool:
    """Raises for what a writer refuses; whether names collide on their hash."""
    if not metrics:
        raise SeriesError("NoMetricsAdded")
    if len(metrics) > MAX_METRICS:
        raise SeriesError("MetricCountExceeded")
    by_name = {m.name is not None for m in metrics}
    if len(by_name) > 1:
        raise SeriesError("MixedIdentifierMode")
    named = by_name == {True}
    if named and (any(m.name == "" for m in metrics) or len({m.name for m in metrics}) < len(metrics)):
        raise SeriesError("InvalidMetricName")
    idents = [m.ident for m in metrics]
    if not named and 0 in idents:
        raise SeriesError("InvalidMetricID")
    repeated = len(set(idents)) < len(idents)
    if repeated and not named:
        raise SeriesError("HashCollision")
    return named and repeated


def _check_points(m: Metric) -> None:
    if not len(m.ts):
        raise SeriesError("NoDataPointsAdded")
    if len(m.val) != len(m.ts) or (m.tags is not None and len(m.tags) != len(m.ts)):
        raise SeriesError("DataPointCountMismatch")


def pack_numeric(m: Metric, config: Config) -> Packed:
    _check_points(m)
    little = not config.big_endian
    tag = _put_strings(m.tags or [""] * len(m.ts)) if config.tags else b""
    ts, val = timestamp_bytes(np.asarray(m.ts, np.int64), config.ts, little), value_bytes(np.asarray(m.val, np.float64), config.val, little)
    return Packed(m.ident, m.name, len(m.ts), ts, val, tag, config.tags and any(m.tags or ()))


def encode_numeric(start: int, metrics: list[Metric], config: Config = Config()) -> bytes:
    """One numeric blob. Names are stored only if two of them share an id, tags only if one is not empty."""
    _check(metrics)
    return join_numeric(start, [pack_numeric(m, config) for m in metrics], config)


def join_numeric(start: int, metrics: list[Packed], config: Config) -> bytes:
    """The blob of packed metrics; config may differ from that of packing in its layout only."""
    collision = _check(metrics)
    mark = "<" if not config.big_endian else ">"
    if config.v2:
        metrics = sorted(metrics, key=lambda m: m.ident)
    tagged = any(m.tagged for m in metrics)
    ts, val = [m.ts for m in metrics], [m.val for m in metrics]
    tag = [m.tag if tagged else b"" for m in metrics]
    shared: dict[bytes, list[int]] = {}
    if config.shared:
        for i, column in enumerate(ts):
            shared.setdefault(column, []).append(i)
        shared = {c: g for c, g in shared.items() if len(g) > 1}
        for group in shared.values():
            for i in group[1:]:
                ts[i] = b""
    table = b""
    if shared:
        table = struct.pack(mark + "H", len(shared)) + b"".join(struct.pack(mark + f"{len(g) + 1}H", g[0], len(g) - 1, *g[1:]) for g in shared.values())
    offsets = [[0, *map(len, part[:-1])] for part in (ts, val, tag)]  # from one metric to the next
    counts = [m.n for m in metrics]
    wide = max(max(map(max, offsets)), max(counts)) > MAX_COMPACT
    if wide and not config.v2:
        raise SeriesError("OffsetOutOfRange")
    form = mark + ("QIIII8x" if wide else "QHHHH")
    index = b"".join(struct.pack(form, m.ident, n, *o) for m, n, *o in zip(metrics, counts, *offsets, strict=True))
    names = _put_names([m.name for m in metrics], mark) if collision else b""
    magic = NUMERIC_V1 if not config.v2 else NUMERIC_V2_WIDE if wide else NUMERIC_V2
    options = magic | TAGS * tagged | BIG_ENDIAN * config.big_endian | HAS_NAMES * bool(names) | SHARED * bool(table)
    sections = [block.compress(b"".join(ts), config.ts_block), block.compress(b"".join(val), config.val_block), block.compress(b"".join(tag), block.ZSTD) if tagged else b""]
    at = HEADER + len(names)
    ends = np.cumsum([at + len(index) + len(table), len(sections[0]), len(sections[1])]).tolist()
    if ends[-1] + len(sections[2]) > MAX_BLOB:
        raise SeriesError("BlobSizeExceedsLimit")
    head = struct.pack("<H", options) + bytes([config.ts | config.val << 4, config.ts_block | config.val_block << 4]) + struct.pack(mark + "qIIIII", start, len(metrics), at, *ends)
    return head + names + index + table + b"".join(sections)


def pack_text(start: int, m: Metric, config: TextConfig) -> Packed:
    """The rows of a metric: per point its timestamp, the lengths of value and tag, and both."""
    _check_points(m)
    if len(m.ts) > MAX_COMPACT:
        raise SeriesError("OffsetOutOfRange")
    mark, out, last = "<" if not config.big_endian else ">", bytearray(), start
    for i, (t, v) in enumerate(zip(np.asarray(m.ts, np.int64).tolist(), m.val, strict=True)):
        raw, tag = v.encode(), (m.tags[i] if m.tags else "").encode()
        if len(raw) > MAX_TEXT or (config.tags and len(tag) > MAX_TEXT):
            raise SeriesError("ValueTooLong")
        d = t - last
        out += put_varint((d << 1 ^ d >> 63) & 0xFFFFFFFFFFFFFFFF) if config.ts == DELTA else b"\x08" + struct.pack(mark + "q", t)
        last = t
        out += bytes([len(raw), len(tag)]) + raw + tag if config.tags else bytes([len(raw)]) + raw
    return Packed(m.ident, m.name, len(m.ts), b"", bytes(out))


def encode_text(start: int, metrics: list[Metric], config: TextConfig = TextConfig()) -> bytes:
    """One text blob."""
    _check(metrics)
    return join_text(start, [pack_text(start, m, config) for m in metrics], config)


def join_text(start: int, metrics: list[Packed], config: TextConfig) -> bytes:
    """The blob of packed metrics."""
    _check(metrics)
    mark = "<" if not config.big_endian else ">"
    out = b"".join(m.val for m in metrics)
    starts = np.cumsum([0, *(len(m.val) for m in metrics[:-1])]).tolist()
    named = metrics[0].name is not None
    names = _put_names([m.name for m in metrics], mark) if named else b""
    index = b"".join(struct.pack(mark + "QHHI", m.ident, m.n, 0, o) for m, o in zip(metrics, starts, strict=True))
    options = TEXT_V1 | TAGS * config.tags | BIG_ENDIAN * config.big_endian | HAS_NAMES * named
    at = HEADER + len(names)
    head = struct.pack("<H", options) + bytes([config.ts, config.block]) + struct.pack(mark + "qIIII4x", start, len(metrics), at, at + len(index), len(out))
    return head + names + index + block.compress(out, config.block)


def kind_of(data: bytes) -> str | None:
    """numeric, text, or none for what is not a blob."""
    if len(data) < 2:
        return None
    magic = int.from_bytes(data[:2], "little") & MAGIC
    return "numeric" if magic in (NUMERIC_V1, NUMERIC_V2, NUMERIC_V2_WIDE) else "text" if magic == TEXT_V1 else None


def decode(data: bytes) -> Blob:
    """The blob in some bytes; what is damaged is an error, whatever the damage."""
    blob, metrics = decode_each(data)
    blob.metrics = list(metrics)
    return blob


def decode_each(data: bytes) -> tuple[Blob, Iterator[Metric]]:
    """(the blob without its metrics, its metrics, decoded one at a time)."""
    if len(data) < HEADER:
        raise SeriesError("InvalidHeaderSize")
    kind = kind_of(data)
    if kind is None:
        raise SeriesError("InvalidMagicNumber")
    parts = _checked(_decode_numeric(data) if kind == "numeric" else _decode_text(data))
    return next(parts), parts


def _checked(parts: Iterator) -> Iterator:
    try:
        yield from parts
    except (struct.error, IndexError, UnicodeDecodeError, OverflowError) as e:
        raise SeriesError("DataSizeMismatch", str(e)) from e


def _slices(offsets: list[int], size: int, code: str) -> list[slice]:
    ends = [*offsets[1:], size]
    if any(b < a for a, b in zip(offsets, ends, strict=True)) or (offsets and offsets[0] < 0):
        raise SeriesError(code)
    return [slice(a, b) for a, b in zip(offsets, ends, strict=True)]


def _verified(names: list[str], idents: list[int]) -> list[str]:
    if any(xxh64_intdigest(n.encode()) != i for n, i in zip(names, idents, strict=True)):
        raise SeriesError("HashMismatch")
    return names


def _decode_numeric(data: bytes) -> Iterator[Blob | Metric]:
    options = int.from_bytes(data[:2], "little")
    little = not options & BIG_ENDIAN
    mark = "<" if little else ">"
    ts_kind, val_kind = data[2] & 15, data[2] >> 4
    ts_block, val_block = data[3] & 15, data[3] >> 4
    if ts_kind not in (RAW, DELTA, DELTA_PACKED) or val_kind not in (RAW, GORILLA, CHIMP, ALP) or ts_block not in block.NAMES or val_block not in block.NAMES:
        raise SeriesError("InvalidHeaderFlags")
    start, count, at, a, b, c = struct.unpack_from(mark + "qIIIII", data, 4)
    if count > MAX_METRICS:
        raise SeriesError("InvalidMetricCount")
    wide = options & MAGIC == NUMERIC_V2_WIDE
    entry = WIDE_ENTRY if wide else ENTRY
    if not HEADER <= at <= len(data) or at + entry * count > len(data):
        raise SeriesError("InvalidIndexEntrySize")
    if not at + entry * count <= a <= len(data):
        raise SeriesError("InvalidTimestampPayloadOffset")
    if not a <= b <= len(data):
        raise SeriesError("InvalidValuePayloadOffset")
    if not b <= c <= len(data):
        raise SeriesError("InvalidTagPayloadOffset")
    tagged = bool(options & TAGS)
    ts, val = block.decompress(data[a:b], ts_block), block.decompress(data[b:c], val_block)
    tag = block.decompress(data[c:], block.ZSTD) if tagged else b""
    rows = []
    for i in range(count):
        rows.append(struct.unpack_from(mark + ("QIIII" if wide else "QHHHH"), data, at + i * entry))
        if wide and any(data[at + i * entry + 24 : at + (i + 1) * entry]):
            raise SeriesError("InvalidReservedBytes")
    columns = [np.cumsum([r[k] for r in rows], dtype=np.int64).tolist() for k in (2, 3, 4)]
    parts = [_slices(o, size, "InvalidIndexOffsets") for o, size in zip(columns, (len(ts), len(val), len(tag)), strict=True)] if tagged else [*(_slices(o, s, "InvalidIndexOffsets") for o, s in zip(columns[:2], (len(ts), len(val)), strict=True)), [slice(0, 0)] * count]
    if options & SHARED:
        parts[0] = _apply_shared(data[at + entry * count : a], parts[0], mark)
    names = None
    if options & HAS_NAMES:
        names, end = _get_names(data, HEADER, count, mark)
        if end != at:
            raise SeriesError("InvalidMetricNamesPayload")
        _verified(names, [r[0] for r in rows])
    layout = {NUMERIC_V1: "v1", NUMERIC_V2: "v2", NUMERIC_V2_WIDE: "v2ext"}[options & MAGIC]
    yield Blob("numeric", start, [], ts_kind, val_kind, layout, tagged, names is not None, not little, len(data), {"shared": bool(options & SHARED), "ts_block": ts_block, "val_block": val_block})
    for i, (ident, n, *_) in enumerate(rows):
        tags = _get_strings(tag[parts[2][i]], n) if tagged else None
        yield Metric(ident, _ts_from(ts[parts[0][i]], n, ts_kind, little), value_from(val[parts[1][i]], n, val_kind, little), tags, names[i] if names else None)


def _apply_shared(data: bytes, parts: list[slice], mark: str) -> list[slice]:
    """Members of a group take the group's first column; every damaged table is an error."""
    bad = SeriesError("InvalidSharedTimestampTable")
    if len(data) < 2 or len(data) % 2:
        raise bad
    n, *rest = struct.unpack(mark + f"{len(data) // 2}H", data)
    out, role, at = list(parts), {}, 0
    if n == 0:
        raise bad
    for _ in range(n):
        if at + 2 > len(rest):
            raise bad
        first, members = rest[at], rest[at + 2 : at + 2 + rest[at + 1]]
        if len(members) < rest[at + 1] or first >= len(parts) or first in role:
            raise bad
        for m in members:
            if m >= len(parts) or m == first or m in role:
                raise bad
            out[m], role[m] = parts[first], "member"
        role[first] = "first"
        at += 2 + len(members)
    if at != len(rest):
        raise bad
    return out


def _decode_text(data: bytes) -> Iterator[Blob | Metric]:
    options = int.from_bytes(data[:2], "little")
    little = not options & BIG_ENDIAN
    mark = "<" if little else ">"
    ts_kind, kind = data[2], data[3]
    if options & SHARED or ts_kind not in (RAW, DELTA) or kind not in block.NAMES:
        raise SeriesError("InvalidHeaderFlags")
    start, count, at, body, size = struct.unpack_from(mark + "qIIII", data, 4)
    if count > MAX_METRICS:
        raise SeriesError("InvalidMetricCount")
    if not HEADER <= at <= len(data) or at + ENTRY * count > len(data) or not at + ENTRY * count <= body <= len(data):
        raise SeriesError("InvalidIndexEntrySize")
    raw = block.decompress(data[body:], kind)
    if len(raw) != size:
        raise SeriesError("DataSizeMismatch")
    rows = [struct.unpack_from(mark + "QHHI", data, at + i * ENTRY) for i in range(count)]
    parts = _slices([r[3] for r in rows], size, "InvalidIndexOffsets")
    names = None
    if options & HAS_NAMES:
        names, end = _get_names(data, HEADER, count, mark)
        if end != at:
            raise SeriesError("InvalidMetricNamesPayload")
        _verified(names, [r[0] for r in rows])
    tagged = bool(options & TAGS)
    yield Blob("text", start, [], ts_kind, RAW, "v1", tagged, names is not None, not little, len(data), {"ts_block": kind})
    for i, (ident, n, _, _) in enumerate(rows):
        part, p, last = raw[parts[i]], 0, start
        ts, val, tags = [], [], []
        for _ in range(n):
            if ts_kind == DELTA:
                u, p = get_varint(part, p)
                last += u >> 1 ^ -(u & 1)
            else:
                (last,) = struct.unpack_from(mark + "q", part, p + 1)
                p += 9
            lengths = part[p], part[p + 1] if tagged else 0
            p += 2 if tagged else 1
            if p + sum(lengths) > len(part):
                raise SeriesError("DataSizeMismatch")
            ts.append(last)
            val.append(part[p : p + lengths[0]].decode())
            tags.append(part[p + lengths[0] : p + sum(lengths)].decode())
            p += sum(lengths)
        yield Metric(ident, np.array(ts, np.int64), val, tags if tagged else None, names[i] if names else None)
