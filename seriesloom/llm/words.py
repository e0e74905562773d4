"""Words of UTF-8 texts for functions that work on bytes: `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a text whose words are listed at once.
PIECE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size. bytes.split() splits at just these six characters."""
    if len(text) <= PIECE:
        yield text.split()
        return
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, min(at + PIECE, len(text)))
        stop = gap.start() if gap else len(text)
        yield text[at:stop].split()
        at = stop


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in the texts, words of each text), A-Z lower-cased, for an Arrow array of strings."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves an empty piece
    if not full.all():
        flat = flat.filter(pa.array(full))
    before = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(before)


def text_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of runs of texts of about `size` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop
