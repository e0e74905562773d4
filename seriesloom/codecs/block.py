"""Block compression of a blob's sections. Empty stays empty; expansion is limited.

S2 sections are written as Snappy blocks, which S2 readers take; of S2 sections
only those in that common form can be read.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard

from seriesloom.errors import SeriesError

#: Ids of the compressions, and the largest size that a section may expand to.
NONE, ZSTD, S2, LZ4 = 1, 2, 3, 4
NAMES = {NONE: "None", ZSTD: "Zstd", S2: "S2", LZ4: "LZ4"}
LIMIT = 128 << 20


def compress(data: bytes, kind: int) -> bytes:
    if kind == NONE or not data:
        return data
    if kind == ZSTD:
        return zstandard.ZstdCompressor().compress(data)
    if kind == S2:
        return pa.Codec("snappy").compress(data, asbytes=True)
    if kind == LZ4:
        return pa.Codec("lz4_raw").compress(data, asbytes=True)
    raise SeriesError("UnsupportedCompression", NAMES.get(kind, str(kind)))


def decompress(data: bytes, kind: int) -> bytes:
    if kind == NONE or not data:
        return data
    if kind == S2:
        return _snappy(data)
    if kind == LZ4:
        return _lz4(data)
    if kind != ZSTD:
        raise SeriesError("UnsupportedCompression", NAMES.get(kind, str(kind)))
    try:
        reader = zstandard.ZstdDecompressor().stream_reader(data)
        out = reader.read(LIMIT + 1)
    except zstandard.ZstdError as e:
        raise SeriesError("DataSizeMismatch", str(e)) from e
    if len(out) > LIMIT:
        raise SeriesError("DecompressedSizeExceedsLimit")
    return out


def _snappy(data: bytes) -> bytes:
    size = shift = at = 0
    while at < len(data) and at < 5:  # the size of the content: seven bits a byte
        size |= (data[at] & 0x7F) << shift
        shift += 7
        at += 1
        if data[at - 1] < 0x80:
            break
    if size > LIMIT:
        raise SeriesError("DecompressedSizeExceedsLimit")
    try:
        return pa.Codec("snappy").decompress(data, size, asbytes=True)
    except (OSError, ValueError) as e:
        raise SeriesError("UnsupportedCompression", "S2 beyond Snappy, or damaged") from e


def _lz4_size(data: bytes) -> int:
    """Bytes that a block expands to, from the lengths of its runs: a block does not tell its size."""

    def length(n: int, at: int) -> tuple[int, int]:
        if n == 15:
            while True:
                n += data[at]
                at += 1
                if data[at - 1] < 255:
                    break
        return n, at

    at = size = 0
    while True:
        token = data[at]
        literals, at = length(token >> 4, at + 1)
        size, at = size + literals, at + literals
        if at > len(data):
            raise IndexError("literals beyond the block")
        if at == len(data):
            return size
        match, at = length(token & 15, at + 2)
        size += match + 4


def _lz4(data: bytes) -> bytes:
    try:
        size = _lz4_size(data)
        if size > LIMIT:
            raise SeriesError("DecompressedSizeExceedsLimit")
        return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)
    except (OSError, IndexError) as e:
        raise SeriesError("DataSizeMismatch", "LZ4 block") from e
