"""Language-model scores of whole documents.

The model (attention.py) learns from every document outside the held-out fold:
counts of all its words and subwords, class trigrams of all its text, and
attention weights from all its windows, ends and short texts included. A window
belongs to a round and a shard by a hash of its text's doc_id, its place and its
content; in a round every shard trains on its windows, in the order of the hash,
and the weights are averaged. What is learned so does not depend on files or
partitions (beyond the last digits of sums).

Three passes over the text:
  1. words of the training fold, counted (combined before the shuffle);
  2. class trigrams, and training windows as codes of two bytes a subword;
  3. scores. A document's frequent words find their counts in a table of a
     bounded size (those with at least one of 2**HEAVY_BITS training tokens, long
     ones by their digest); its other words go to shards by 96 bits of their
     hash, packed, where each word's training count follows from its
     occurrences, and the counts go back by row.

A subword vocabulary file in tiktoken's format is read by the driver and sent
to the tasks; its path is a parameter.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import replace
from hashlib import sha256
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from seriesloom.llm import attention as A
from seriesloom.llm.substrings import _by_key, _mixed, _packed, _unpacked, row_bucket, shards_for
from seriesloom.llm.words import lower_words, text_slices
from seriesloom.runtime import cut, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a word before byte pairs are merged: letters, digits, other marks, other white space; a space goes with what follows it.
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+| ?[^\S ]+| "
#: Words with at least N / 2**HEAVY_BITS of N training tokens are looked up in a broadcast table, those of over WORD_BYTES bytes by digest.
HEAVY_BITS, WORD_BYTES = 18, 64
#: Distinct words that a task remembers; bytes of text whose words are counted, and scored, at once; rare words held before they are sent on.
WORDS_HELD, COUNT_BYTES, SLICE_BYTES, RARE_HELD = 250_000, 1 << 23, 1 << 20, 500_000
#: Rounds of averaging; windows of a shard in a round; windows held before they are sent on; bytes of text for a shard of words.
ROUNDS, SHARD_WINDOWS, WINDOWS_HELD, SHARD_BYTES = 4, 1 << 16, 1 << 16, 1 << 24
#: Shards whose weights are averaged at once.
SUM_SHARDS = 64
#: Characters of a word that are tokenized at once.
SLICE = 200
CHUNK_BITS = 16


class Subwords:
    """Words to ids of a byte-pair vocabulary; a word is encoded with the space before it."""

    def __init__(self, data: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.begins_word = np.zeros(self.size + 1, bool)
        self.begins_word[[k for piece, k in self.ranks.items() if piece[:1] == b" "]] = True

    def __call__(self, word: bytes) -> list[int]:
        text = " " + word.decode("utf-8", "replace")
        if len(text) <= SLICE:
            return self.encoding.encode_ordinary(text)
        return list(chain.from_iterable(self.encoding.encode_ordinary(text[k : k + SLICE]) for k in range(0, len(text), SLICE)))

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word): all words at once, split where an id begins with a space.

        The same as one by one, which it falls back to where white space at a word's end joins the next one.
        """
        if all(len(w) <= SLICE for w in words):
            ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int32)
            starts = np.flatnonzero(self.begins_word[ids])
            if len(starts) == len(words) and starts[0] == 0:
                return ids, np.diff(starts, append=len(ids))
        runs = [self(w) for w in words]
        return np.array(list(chain.from_iterable(runs)), np.int32), np.array(list(map(len, runs)))


_subwords: dict[int, Subwords] = {}


def subwords(data: Broadcast) -> Subwords:
    """One vocabulary a worker process."""
    key = hash(data.value)
    if key not in _subwords:
        _subwords.clear()
        _subwords[key] = Subwords(data.value)
    return _subwords[key]


def heavy_key(word: bytes) -> bytes:
    """The word, or its digest; no word has a space in it."""
    return word if len(word) <= WORD_BYTES else b" " + sha256(word).digest()


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from; a null doc_id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in each run of texts; further summed before the shuffle."""
    for batch in batches:
        for _, texts in text_slices(batch.column(0), COUNT_BYTES):
            words, numbers, _ = lower_words(texts)
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(numbers, minlength=len(words)))], ["word", "n"])


def _count_ids(batches: Iterator[pa.RecordBatch], data: Broadcast) -> Iterator[pa.RecordBatch]:
    """Corpus counts of subword ids from the counts of words."""
    encode = subwords(data)
    total = np.zeros(encode.size, np.int64)
    for batch in batches:
        words = batch.column(0).to_pylist()
        if words:
            ids, sizes = encode.many(words)
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), sizes))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


class Growing:
    """An array that values are appended to."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def extend(self, values: list | np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.zeros(2 * size, self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : size] = values
        self.size = size


class Lexicon:
    """Words seen by a task: a run of ids for each, and with `heavy` its training count, or -1, and hashes.

    Starts anew after WORDS_HELD words.
    """

    def __init__(self, encode: Subwords, heavy: dict | None = None):
        self.encode, self.heavy = encode, heavy
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = Growing(np.int32), Growing(np.int64), Growing(np.int64)
        self.counts, self.hashes, self.more = Growing(np.int64), Growing(np.uint64), Growing(np.uint32)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words."""
        if len(self.slot) >= WORDS_HELD:
            self.clear()
        slot = self.slot
        new = [w for w in words if w not in slot]
        if new:
            slot.update(zip(new, range(len(slot), len(slot) + len(new)), strict=True))
            ids, sizes = self.encode.many(new)
            self.starts.extend(self.ids.size + np.cumsum(sizes) - sizes)
            self.sizes.extend(sizes)
            self.ids.extend(ids)
            if self.heavy is not None:
                self.counts.extend(list(map(self.heavy.get, map(heavy_key, new), repeat(-1))))
                digests = np.frombuffer(b"".join(map(xxh3_128_digest, new)), "<u8").reshape(-1, 2)
                self.hashes.extend(digests[:, 0])
                self.more.extend((digests[:, 1] >> np.uint64(32)).astype(np.uint32))
        return np.fromiter(map(slot.__getitem__, words), np.int64, len(words))

    def rows(self, slots: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, ids of each word, and with `heavy` counts and two hashes) of some words."""
        sizes = self.sizes.room[slots]
        ids = self.ids.room[_runs(self.starts.room[slots], sizes)]
        return (ids, sizes) if self.heavy is None else (ids, sizes, self.counts.room[slots], self.hashes.room[slots], self.more.room[slots])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _encoded(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, column: int) -> Iterator[tuple]:
    """(batch, rows, ids, sizes, words, more) for some texts at a time: their ids, each text with its end (the vocabulary's size).

    sizes, words: of each text. more: what the lexicon has beside ids, for each word of all the texts.
    """
    for batch in batches:
        for first, texts in text_slices(batch.column(column), SLICE_BYTES):
            words, numbers, n_words = lower_words(texts)
            slots = lexicon.slots(words.cast(pa.binary()).to_pylist())[numbers]
            ids, sizes, *more = lexicon.rows(slots)
            tokens = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(n_words)]  # up to each text's end
            own = np.diff(tokens, prepend=0) + 1
            out = np.full(len(ids) + len(texts), lexicon.encode.size, np.int32)
            inside = np.ones(len(out), bool)
            inside[np.cumsum(own) - 1] = False
            out[inside] = ids
            yield batch, first + np.arange(len(texts)), out, own, n_words, more


def _before(y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each place and the one before that; 0 before a text's first."""
    begins = np.cumsum(sizes) - sizes
    one, two = np.empty_like(y), np.empty_like(y)
    one[1:] = y[:-1]
    one[begins] = 0
    two[1:] = one[:-1]
    two[begins] = 0
    return one, two


class Tally:
    """Counts of many cells, in two bytes each; a count that outgrows them is put aside and begins anew."""

    def __init__(self, size: int):
        self.room = np.zeros(size, np.uint16)
        self.aside: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, cells: np.ndarray) -> None:
        """Add one to each cell; sorted first, as the table is larger than the cache."""
        cells = np.sort(cells)
        new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        at = cells[new]
        n = self.room[at] + np.diff(new, append=len(cells))
        over = np.flatnonzero(n >> 16)
        if len(over):
            self.aside.append((at[over], n[over]))
            n[over] = 0
        self.room[at] = n

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(chunk, cells in it, their counts); the counts of a cell in all of them add up, within one a cell is there once."""
        for k in range(0, len(self.room), 1 << CHUNK_BITS):
            at = np.flatnonzero(part := self.room[k : k + (1 << CHUNK_BITS)])
            if len(at):
                yield k >> CHUNK_BITS, at, part[at]
        if self.aside:
            at, n = (np.concatenate(x) for x in zip(*self.aside, strict=True))
            at, own = np.unique(at, return_inverse=True)
            n = np.bincount(own, n)
            for k in np.unique(at >> CHUNK_BITS).tolist():
                x = slice(*np.searchsorted(at, [k << CHUNK_BITS, (k + 1) << CHUNK_BITS]))
                yield k, at[x] - (k << CHUNK_BITS), n[x]


#: Odd numbers that a window's codes are multiplied by.
_ODD = np.random.default_rng(77).integers(0, 1 << 63, A.WINDOW + 2, np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the text's number, its window's number, codes of the window with the two before it): windows side by side that cover every text."""
    n = -(-sizes // A.WINDOW)
    begins = np.cumsum(sizes) - sizes
    text, turn = np.repeat(np.arange(len(sizes)), n), _runs(np.zeros(len(sizes), np.int64), n)
    at = turn[:, None] * A.WINDOW + np.arange(-2, A.WINDOW)
    out = codes[np.clip(begins[text][:, None] + at, 0, len(codes) - 1)]
    out[at < 0] = A.KNOWN + 1  # as if the end of another text came before
    out[at >= sizes[text][:, None]] = A.PAD
    return text, turn, out


def _count_classes(batches: Iterator[pa.RecordBatch], data: Broadcast, model: Broadcast, shards: int) -> Iterator[pa.RecordBatch]:
    """Trigram cells and (class, known id) cells of this task's texts, by chunks of cells, and windows by round and shard."""
    m: A.Model = model.value
    cells, given = Tally(A.CLASSES**3), Tally(A.CLASSES * (A.KNOWN + 1))
    held: list[tuple] = []
    names = ["chunk", "round", "shard", "data"]

    def flush() -> Iterator[pa.RecordBatch]:
        h, windows = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        place = (h >> np.uint64(2)) % np.uint64(shards) * np.uint64(ROUNDS) + h % np.uint64(ROUNDS)
        order = np.argsort(place, kind="stable")
        keys, first = np.unique(place[order], return_index=True)
        parts = [_packed(h[x], windows[x].reshape(len(x), -1)) for x in np.split(order, first[1:])]
        keys = keys.astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int32()), pa.array(keys % ROUNDS), pa.array(keys // ROUNDS), pa.array(parts, pa.binary())], names)

    n = 0
    for batch, rows, ids, sizes, *_ in _encoded(batches, Lexicon(subwords(data)), 1):
        y = m.class_of[ids].astype(np.int32)
        one, two = _before(y, sizes)
        cells.add((two * A.CLASSES + one) * A.CLASSES + y)
        given.add(one * (A.KNOWN + 1) + m.column[ids])
        text, turn, windows = _windows(m.code_of[ids], sizes)
        owner = batch.column(0).fill_null(-1).to_numpy()[rows].view(np.uint64)
        h = _mixed(_mixed(owner[text]) ^ turn.astype(np.uint64) * _ODD[0])
        held.append((_mixed(h + windows.astype(np.uint64) @ _ODD), windows))
        n += len(windows)
        if n >= WINDOWS_HELD:
            yield from flush()
            n = 0
    if n:
        yield from flush()
    for tally, base in ((cells, 0), (given, len(cells.room) >> CHUNK_BITS)):
        keys, parts = [], []
        for k, at, count in tally.chunks():
            keys.append(base + k)
            parts.append(_packed(at.astype("<u2"), count.astype("<u4")))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.int32()), pa.array(parts, pa.binary())], names)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, n = _unpacked(data, "<u2", "<u4")
            total.setdefault(key, np.zeros(1 << CHUNK_BITS, np.int64))[at] += n
    for key, t in total.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([_packed(at.astype("<u2"), t[at])], pa.binary())], ["chunk", "data"])


def _train(batches: Iterator[pa.RecordBatch], tables: Broadcast, params: Broadcast, step: int) -> Iterator[pa.RecordBatch]:
    """The weights of each shard after a pass over its windows, and how many these are; rows come sorted by shard."""
    m: A.Model = tables.value
    for shard, parts in _by_key(batches):
        found = [_unpacked(p[0], "<u8", f"({A.WINDOW + 2},)<u2") for p in parts]
        h, windows = (np.concatenate(x) for x in zip(*found, strict=True))
        windows = windows[np.argsort(h, kind="stable")]
        weights = A.train(m, params.value, windows, rate=0.004 / (1 + step))
        flat = np.concatenate([weights[k].reshape(-1) for k in A.NAMES]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(windows)]), pa.array([flat.tobytes()], pa.binary())], ["shard", "n", "weights"])


def _sum_group(table: pa.Table) -> pa.Table:
    """The mean weights of at most SUM_SHARDS shards."""
    table = table.sort_by("k")
    n = table.column("n").to_pylist()
    total = sum(k * np.frombuffer(w.as_py(), "<f4").astype(np.float64) for k, w in zip(n, table.column("weights"), strict=True)) / sum(n)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": [sum(n)], "weights": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, doc_id: str, text: str, data: Broadcast) -> tuple[Broadcast, dict, dict, int, int, int]:
    """(the model's tables, its weights, heavy words with their counts, texts, N, V) from the rows outside the held-out fold.

    The tables are sent once, the weights anew each round; of a round the driver gets one mean, however many shards it has.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.where(~held_out(F.col(doc_id))).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = stored(texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = texts.count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    key = F.when(F.octet_length("word") <= WORD_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.sha2("word", 256))))
    heavy = words.where(F.col("n") >= max(1, n >> HEAVY_BITS)).select(key.alias("word"), "n").toPandas()  # at most 2**HEAVY_BITS words of 64 bytes
    heavy = dict(zip(map(bytes, heavy["word"]), heavy["n"].tolist(), strict=True))
    encode = Subwords(data.value)
    counts = np.zeros(encode.size + 1)
    for r in words.mapInArrow(lambda it: _count_ids(it, data), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id
        counts[r.id] = r.n
    counts[-1] = ends
    model = A.classes(counts, encode.begins_word)
    first = sc.broadcast(model)
    shards = max(1, int(counts.sum()) // (A.WINDOW * ROUNDS * SHARD_WINDOWS))
    found = stored(texts.mapInArrow(lambda it: _count_classes(it, data, first, shards), "chunk int, round int, shard int, data binary"), "classes")
    cells = np.zeros(A.CLASSES**3 + A.CLASSES * (A.KNOWN + 1), np.float32)
    sums = found.where("chunk is not null").select("chunk", "data").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, data binary")
    for r in sums.toLocalIterator():  # at most a number a cell of the two tables
        at, k = _unpacked(r.data, "<u2", "<i8")
        cells[(r.chunk << CHUNK_BITS) + at.astype(np.int64)] = k
    tables = sc.broadcast(A.with_counts(model, cells[: A.CLASSES**3], cells[A.CLASSES**3 :].reshape(A.CLASSES, -1)))
    first.destroy()
    del cells, model
    params = A.fresh()
    windows = found.where("chunk is null")
    for step in range(ROUNDS):
        now = sc.broadcast(params)
        mine = windows.where(F.col("round") == step).select("shard", "data").repartition("shard").sortWithinPartitions("shard")
        trained = cut(mine.mapInArrow(lambda it, now=now, step=step: _train(it, tables, now, step), "shard int, n long, weights binary"))
        now.destroy()  # unpersist() would leave the driver's copy
        # Sums of SUM_SHARDS shards at a time, until one is left.
        left = shards
        while left > 1:
            trained = trained.select(F.floor(F.col("shard") / SUM_SHARDS).cast("int").alias("shard"), F.col("shard").alias("k"), "n", "weights")
            trained = cut(trained.groupBy("shard").applyInArrow(_sum_group, "shard int, n long, weights binary"))
            left = -(-left // SUM_SHARDS)
        mean = trained.first()
        if mean is None:
            continue
        values, at = np.frombuffer(mean.weights, "<f4"), 0
        for k in A.NAMES:
            size = params[k].size
            params[k] = values[at : at + size].astype(np.float32).reshape(params[k].shape)
            at += size
    return tables, A.bounded(params), heavy, ends, n, v


class Fitted:
    """What a task scores with: the model's tables, and (weights, heavy words, texts), which are sent apart from them."""

    def __init__(self, tables: Broadcast, learned: Broadcast):
        self.tables, self.learned = tables, learned

    @property
    def value(self) -> tuple[A.Model, dict, int]:
        params, heavy, ends = self.learned.value
        return replace(self.tables.value, params=params), heavy, ends


def _score(batches: Iterator[pa.RecordBatch], data: Broadcast, fitted: Broadcast | Fitted, shards: int) -> Iterator[pa.RecordBatch]:
    """Scores, sums over frequent words, and the rest of the words by shard."""
    model, heavy, ends = fitted.value
    rare: list[tuple] = []
    held = 0

    docs: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        h, g, row, train = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "<i8"), np.zeros(0, "u1"))
        rare.clear()
        held = 0
        shard = (h % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        h, g, row, train, shard = h[order], g[order], row[order], train[order], shard[order]
        mine: dict[int, list] = {}
        for b, d in zip(row_bucket([d[0] for d in docs], shards).tolist(), docs, strict=True):
            mine.setdefault(b, []).append(d)
        docs.clear()
        keys, words, rows = [], [], []
        for s in np.union1d(shard, np.array(list(mine), np.int64)).tolist():
            x = slice(*np.searchsorted(shard, [s, s + 1]))
            keys.append(s)
            words.append(_packed(h[x], g[x], row[x], train[x]))
            rows.append(json.dumps(mine.get(s, [])).encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(words, pa.binary()), pa.array(rows, pa.binary())], ["shard", "words", "rows"])

    end = float(np.log10(ends + 1.0))
    for batch, rows, ids, sizes, n_words, (counts, hashes, more) in _encoded(batches, Lexicon(subwords(data), heavy), 2):
        y = model.class_of[ids].astype(np.int32)
        one, _ = _before(y, sizes)
        own = A.id_shares(model, ids, one)
        scores = A.text_scores(model, model.code_of[ids], sizes) + np.add.reduceat(own.astype(np.float64), np.cumsum(sizes) - sizes)
        number, out = (np.array(batch.column(k).to_pylist())[rows] for k in (0, 3))
        doc_id = batch.column(1).take(pa.array(rows)).to_pylist()
        often = counts >= 0
        owner = np.repeat(np.arange(len(rows)), n_words)
        known = np.bincount(owner[often], minlength=len(rows)) + (ends > 0)
        total = np.bincount(owner[often], np.log10(counts[often] + 1.0), len(rows)) + end
        rare.append((hashes[~often], more[~often], number[owner[~often]], (~out[owner[~often]]).astype(np.uint8)))
        held += len(rare[-1][0])
        docs += zip(number.tolist(), doc_id, out.tolist(), (n_words + 1).tolist(), known.tolist(), total.tolist(), scores.tolist(), strict=True)
        if held >= RARE_HELD or len(docs) >= RARE_HELD // 10:
            yield from flush()
    if held or docs:
        yield from flush()


def _rare_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Training counts of each shard's words, sent back by row."""
    held: list[tuple] = []
    docs: list = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        row, count = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        held.clear()
        bucket = row_bucket(row, buckets)
        order = np.lexsort((row, bucket))
        row, count, bucket = row[order], count[order], bucket[order]
        mine: dict[int, list] = {}
        for b, d in zip(row_bucket([d[0] for d in docs], buckets).tolist(), docs, strict=True):
            mine.setdefault(b, []).append(d)
        docs.clear()
        keys, data, rows = [], [], []
        for b in np.union1d(bucket, np.array(list(mine), np.int64)).tolist():
            x = slice(*np.searchsorted(bucket, [b, b + 1]))
            keys.append(b)
            data.append(_packed(row[x], count[x]))
            rows.append(json.dumps(mine.get(b, [])).encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary()), pa.array(rows, pa.binary())], ["bucket", "counts", "rows"])

    for _, parts in _by_key(batches):
        h, g, row, train = (np.concatenate(x) for x in zip(*(_unpacked(p[0], "<u8", "<u4", "<i8", "u1") for p in parts), strict=True))
        if len(h):
            order = np.lexsort((g, h))
            h, g, row, train = h[order], g[order], row[order], train[order]
            word = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
            held.append((row, np.bincount(word, weights=train)[word].astype(np.uint32)))
            n += len(h)
        for p in parts:
            docs += json.loads(p[1])
        if n >= RARE_HELD:
            yield from flush()
            n = 0
    if held or docs:
        yield from flush()


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _assembled(batches: Iterator[pa.RecordBatch], n: int, v: int) -> Iterator[pa.RecordBatch]:
    unit = float(np.log10(n + v + 1.0))
    names = [f.split()[0] for f in SCORED.split(", ")]
    for _, parts in _by_key(batches):
        row, count = (np.concatenate(x) for x in zip(*(_unpacked(p[0], "<i8", "<u4") for p in parts), strict=True))
        own, at = np.unique(row, return_inverse=True)
        more = dict(zip(own.tolist(), zip(np.bincount(at, np.log10(count + 1.0)).tolist(), np.bincount(at, count > 0).astype(int).tolist(), strict=True), strict=True)) if len(row) else {}
        out = []
        for number, doc_id, held, n_tokens, known, base, score in (d for p in parts for d in json.loads(p[1])):
            add, also = more.get(number, (0.0, 0))
            out.append((doc_id, held, n_tokens, known + also, n, base + add - n_tokens * unit, score))
        if out:
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Tokens are the words of the text after lower-casing A-Z, then one end.
    score: the model's log10 probability of the text's subwords and end, which
    is at most that of its words. base_score: the same by word counts plus
    one. A null or empty text is just its end. A row with a null doc_id is
    scored and learned from; repeated rows are rows like any other. Without
    training rows all counts are 0. `docs` must be a stored table.
    """
    sc = docs.sparkSession.sparkContext
    with open(vocabulary, "rb") as f:  # a file of the driver's, not of the corpus
        data = sc.broadcast(f.read())
    tables, params, heavy, ends, n, v = fit(docs, doc_id, text, data)
    fitted = Fitted(tables, sc.broadcast((params, heavy, ends)))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    shards = shards_for(n_bytes, SHARD_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    sent = rows.mapInArrow(lambda it: _score(it, data, fitted, shards), "shard int, words binary, rows binary")
    back = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _rare_counts(it, shards), "bucket int, counts binary, rows binary")
    return back.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _assembled(it, n, v), SCORED)
