"""The tasks' functions in one process, with limits so small that every buffer is flushed many times."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import attention as A
from seriesloom.llm import lm
from seriesloom.llm import simhash as S
from seriesloom.llm import substrings as W


class Sent:
    def __init__(self, value):
        self.value = value


def dealt(batches, key):
    """All rows, sorted by the first column, in small batches: what a repartition and a sort in one partition give."""
    table = pa.Table.from_batches(batches).sort_by(key)
    return iter(table.to_batches(max_chunksize=3))


def test_substrings(monkeypatch):
    for name, n in (("AT_ONCE", 40), ("WINDOWS_HELD", 60), ("ANCHORS_HELD", 25)):
        monkeypatch.setattr(W, name, n)
    rng = np.random.default_rng(8)
    shared = [f"s{k}" for k in rng.integers(0, 30, 50)]
    rows = []
    for i in rng.permutation(50).tolist():
        a = int(rng.integers(0, 30))
        rows.append((i, " ".join([*(f"w{k}" for k in rng.integers(0, 40, int(rng.integers(0, 40)))), *(shared[a : a + 18] if i % 2 else [])])))
    texts = pa.array([t.encode() for _, t in rows], pa.binary())
    bits = 16
    parts = [b for half in (texts[:25], texts[25:]) for b in W._sketch_parts(iter([pa.RecordBatch.from_arrays([half], ["text"])]), bits, 13, 6)]
    sketch = np.zeros((W.SKETCH_ROWS, 1 << (bits - 3)), np.uint8)
    for b in W._merged(dealt(parts, "chunk")):
        for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sketch[chunk >> (W.MAX_BITS - W.CHUNK_BITS)] |= np.frombuffer(data, np.uint8)
    whole = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([i for i, _ in rows]), texts], ["row_no", "doc_id", "text"])
    found = list(W._candidates(iter([whole.slice(k, 7) for k in range(0, 50, 7)]), Sent(sketch), bits, 4, 13, 6))
    assert len(found) > 2
    solved = list(W._resolved(dealt(found, "shard"), 5))
    assert len(solved) > 1
    removed = dict.fromkeys(range(50), 0)
    for b in W._ranges(dealt(solved, "bucket"), 13):
        for row, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            removed[row] += int(np.diff(np.frombuffer(data, "<i8").reshape(-1, 2), axis=1).sum())
    want = [n for _, _, n, _ in W.brute_force(rows)]
    assert [removed[k] for k in range(50)] == want and sum(want) > 100


@pytest.mark.parametrize("held", [5, 100, 10**6])
def test_lm_words(monkeypatch, held):
    for name, n in (("RARE_HELD", held), ("SLICE_BYTES", 300), ("COUNT_BYTES", 500), ("WORDS_HELD", 40)):
        monkeypatch.setattr(lm, name, n)
    with open(lm.VOCABULARY, "rb") as f:
        data = Sent(f.read())
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"Wo{k}é" if k % 5 else "the" for k in rng.integers(0, 90, int(rng.integers(0, 60)))) + "  ") for i in range(80)]
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    texts = pa.array([t for _, t in rows])
    counts: Counter = Counter()
    for b in lm._count_words(iter([pa.RecordBatch.from_arrays([texts.filter(pa.array(learned))], ["text"])])):
        counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    want = Counter(w for (_, t), y in zip(rows, learned, strict=True) if y for w in t.encode().lower().split())
    assert counts == want
    ends = sum(learned)
    n, v = sum(want.values()) + ends, len(want) + 1
    encode = lm.subwords(data)
    model = A.classes(np.ones(encode.size + 1), encode.begins_word)
    model = A.with_counts(model, np.zeros(A.CLASSES**3, np.float32), np.zeros((A.CLASSES, A.KNOWN + 1), np.float32))
    model.params = A.fresh()
    heavy = {w: c for w, c in want.items() if c > 12}
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([i for i, _ in rows]), texts, pa.array([not y for y in learned])], ["row_no", "doc_id", "text", "held_out"])
    sent = list(lm._score(iter([batch.slice(k, 9) for k in range(0, 80, 9)]), data, Sent((model, heavy, ends)), 4))
    back = list(lm._rare_counts(dealt(sent, "shard"), 3))
    out = {r["doc_id"]: r for b in lm._assembled(dealt(back, "bucket"), n, v) for r in b.to_pylist()}
    assert sorted(out) == list(range(80))
    for (i, t), y in zip(rows, learned, strict=True):
        tokens = t.encode().lower().split()
        base = sum(math.log10((want[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((ends + 1) / (n + v + 1))
        assert out[i]["held_out"] == (not y) and out[i]["n_tokens"] == len(tokens) + 1
        assert out[i]["n_known"] == sum(want[w] > 0 for w in tokens) + 1 and abs(out[i]["base_score"] - base) < 1e-9
        assert math.isfinite(out[i]["score"]) and out[i]["score"] < 0


def test_class_counts_are_those_of_the_texts(monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 100)
    with open(lm.VOCABULARY, "rb") as f:
        data = Sent(f.read())
    encode = lm.subwords(data)
    model = A.classes(np.arange(encode.size + 1, dtype=float), encode.begins_word)
    rows = ["the quick brown fox " * k for k in range(40)]
    cells, windows = Counter(), 0
    monkeypatch.setattr(lm, "WINDOWS_HELD", 20)
    for b in lm._count_classes(iter([pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])]), data, Sent(model), 3):
        for chunk, turn, shard, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk is None:
                h, found = lm._unpacked(raw, "<u8", f"({A.WINDOW + 2},)<u2")
                assert turn < lm.ROUNDS and shard < 3 and found.shape == (len(h), A.WINDOW + 2)
                windows += len(h)
            elif chunk < A.CLASSES**3 >> lm.CHUNK_BITS:
                at, k = lm._unpacked(raw, "<u2", "<u4")
                cells.update(dict(zip(((chunk << lm.CHUNK_BITS) + at.astype(int)).tolist(), k.tolist(), strict=True)))
    want: Counter = Counter()
    for t in rows:
        y = [int(model.class_of[i]) for w in t.encode().split() for i in encode(w)] + [0]
        for k, c in enumerate(y):
            want[((y[k - 2] if k > 1 else 0) * A.CLASSES + (y[k - 1] if k else 0)) * A.CLASSES + c] += 1
    sizes = [sum(len(encode(w)) for w in t.encode().split()) + 1 for t in rows]
    assert cells == want and windows == sum(-(-n // A.WINDOW) for n in sizes)


def test_simhash_runs_are_compared_whole(monkeypatch):
    monkeypatch.setattr(S, "TILE", 2)
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 60)
    fp[1::2] = fp[::2] ^ 5
    key = np.repeat(np.arange(6), 10)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(60, 0)), pa.array(key), pa.array(np.zeros(60, np.int32)), pa.array(np.zeros(60, np.int32)), pa.array(fp), pa.array(np.arange(60))], ["mask", "key", "chunk", "other", "fp", "node"])
    links = [r for b in S._compare(iter([batch.slice(k, 4) for k in range(0, 60, 4)]), 4) for r in b.to_pylist()]
    assert sorted((r["b"], r["a"]) for r in links) == [(k, k + 1) for k in range(0, 60, 2)]
