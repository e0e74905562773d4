"""Exact, near and passage duplicates against brute force."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import simhash as S
from seriesloom.llm import substrings as W
from seriesloom.llm.components import connected_components
from seriesloom.llm.exact_dedup import exact_dedup, keep_distinct
from seriesloom.runtime import cut

SCHEMA = "doc_id long, text string, row_no long, name string, fp string, level int"


def docs(spark, rows, parts=3):
    return cut(spark.createDataFrame([(i, t, 9, "x", "y", 1) for i, t in rows], SCHEMA).repartition(parts))


def lower(t):
    return (t or "").encode().lower()


# ------------------------------------------------------------------------- exact

ROWS = [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 70), (9, "X" * 70), (10, "x" * 69), (11, "x" * 32 + "y" * 32), (12, "y" * 32 + "x" * 32), (2, "aBC"), (None, "abd"), (13, "z" * 1000), (14, "z" * 999 + "Z")]


def test_exact_against_brute_force(spark):
    rows = ROWS + [(100 + i, "hot copy " * 9) for i in range(200)]
    out = exact_dedup(docs(spark, rows), block_bytes=32).collect()
    assert len(out) == len(rows) and len({r.row_no for r in out}) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), sha256(k).hexdigest()) for k, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_blocks_of_one_hash_are_told_apart(spark, monkeypatch):
    """All blocks get one of three hashes."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr("seriesloom.llm.exact_dedup.F.xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    out = exact_dedup(docs(spark, ROWS), block_bytes=32).collect()
    monkeypatch.undo()
    groups = {}
    for _, t in ROWS:
        groups[lower(t)] = groups.get(lower(t), 0) + 1
    assert sorted((r.text_sha256, r.group_size) for r in out) == sorted((sha256(lower(t)).hexdigest(), groups[lower(t)]) for _, t in ROWS)


def test_exact_keeps_columns_and_handles_empty(spark):
    d = docs(spark, ROWS)
    kept = keep_distinct(d)
    assert kept.columns == d.columns and kept.count() == len({lower(t) for _, t in ROWS})
    assert exact_dedup(d.limit(0)).count() == 0


# ----------------------------------------------------------------------- simhash


def plain_fingerprint(text, k=4):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.lists(st.sampled_from([b"a", b"B", b"cc", "é".encode(), b"\x0b", b"\n", b"  "]), max_size=30).map(b" ".join))
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 7)
    text = b" ".join(b"w%d" % (i * i % 31) for i in range(100))
    assert S.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(0, 6))
def test_bit_sliced_links_are_all_links(seed, n, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 4, np.uint64)
    values = np.unique(base[rng.integers(0, 4, n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (6, n)).astype(np.uint64), axis=0) * (rng.random(n) < 0.9).astype(np.uint64))
    (parents,) = S.linked([values], radius)
    near = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in values] for a in values])
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert (parents == label).all()


def test_every_near_pair_shares_a_key():
    rng = np.random.default_rng(2)
    for n in (10, 10**7, 10**10):
        masks = [m % (1 << 64) for m in S.bit_blocks(n, 4)]
        for _ in range(300):
            a = int(rng.integers(0, 2**63))
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            assert any(a & m == b & m for m in masks)


def components(fps, radius=4):
    ids = sorted(fps)
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if best[j] < best[i] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    best[i] = best[j]
                    changed = True
    return best


@pytest.mark.parametrize("tile", [S.TILE, 5])
def test_near_duplicates_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    texts = {}
    for g in range(12):
        base = [words[k] for k in rng.integers(0, 300, 120)]
        for c in range(6):
            copy = list(base)
            for k in rng.integers(0, 120, c // 2):
                copy[k] = words[int(rng.integers(300))]
            texts[100 * g + c] = " ".join(copy)
    texts |= {5000: "", 5001: None, 5002: "one two", 5003: "ONE two"}
    rows = list(texts.items()) + [(5002, "one two"), (None, "one two"), (None, "alone and without an id of its own")]
    out = S.near_duplicates(docs(spark, rows)).collect()
    fps = {i: plain_fingerprint((t or "").encode()) for i, t in texts.items()}
    want = components(fps)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert sorted(str(r.component_id) for r in out if r.doc_id is None) == ["5002", "None"]
    assert len(set(want.values())) < len(want) - 20


def test_no_documents(spark):
    assert S.near_duplicates(docs(spark, ROWS).limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7), (None, 3), (2000, 1999), (1999, 2000)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(301)) and all(out[1000 + k] == 1000 for k in range(200)) and out[2000] == 1999
    assert len(out) == 301 + 200 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -------------------------------------------------------------------- substrings


def passages(seed, n=60, words=13):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{k}" for k in range(40)] + ["É", "the", "The"]
    passage = [vocabulary[k] for k in rng.integers(0, 43, 60)]
    rows = []
    for i in range(n):
        own = [vocabulary[k] for k in rng.integers(0, 43, int(rng.integers(0, 80)))]
        if i % 3 == 0:
            a = int(rng.integers(0, 40))
            own[len(own) // 2 : len(own) // 2] = passage[a : a + int(rng.integers(5, 20))]
        if i % 10 == 0:
            own = own + ["line", "again", "and"] * 12
        rows.append((int(rng.integers(0, 10**6)) if i % 7 else i, "  ".join(own) + "\n"))
    return rows + [(3, None), (4, ""), rows[0], (rows[1][0], rows[3][1]), (None, rows[3][1]), (None, rows[3][1]), (10**7, rows[0][1])]


@pytest.mark.parametrize("small", [False, True])
def test_substrings_against_brute_force(spark, monkeypatch, small):
    if small:  # many flushes, runs and shards
        monkeypatch.setattr(W, "AT_ONCE", 40)
        monkeypatch.setattr(W, "WINDOWS_HELD", 50)
        monkeypatch.setattr(W, "ANCHORS_HELD", 30)
        monkeypatch.setattr(W, "SHARD_BYTES", 100)
    rows = passages(small)
    out = W.digest(W.remove_repeats(docs(spark, rows))).collect()
    want = W.brute_force(rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == Counter(want)
    assert sum(w[2] for w in want) > 200


@pytest.mark.parametrize("parts", [1, 3])
def test_anchors_exchanged_beyond_the_broadcast(spark, monkeypatch, parts):
    monkeypatch.setattr(W, "MAX_BITS", W.CHUNK_BITS - 1)
    monkeypatch.setattr(W, "repeat_sketch", None)
    monkeypatch.setattr(W, "AT_ONCE", 40)
    monkeypatch.setattr(W, "ANCHORS_HELD", 30)
    monkeypatch.setattr(W, "WINDOWS_HELD", 50)
    monkeypatch.setattr(W, "GROUP_BITS", 2)
    monkeypatch.setattr(W, "SHARD_BYTES", 500)
    rows = passages(5 + parts, n=90)
    out = W.digest(W.remove_repeats(docs(spark, rows, parts))).collect()
    want = W.brute_force(rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == Counter(want)
    assert sum(w[2] for w in want) > 200
    assert W.remove_repeats(docs(spark, rows, parts).limit(0)).count() == 0


def test_answers_are_the_repeated_anchors():
    """Of anchors in several buckets, or twice in one, every bucket hears; of others hardly any does."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    anchors = rng.integers(0, 2**63, 5000).astype(np.uint64)
    where = {int(a): [k % 7, (k + 1) % 7] if k % 10 == 0 else [k % 7] for k, a in enumerate(anchors)}
    twice = {int(a) for k, a in enumerate(anchors) if k % 15 == 1}
    sent = []
    for bucket in range(7):
        own = np.array([a for a, b in where.items() if bucket in b], np.uint64)
        sent.append(W._packed(own, np.full(len(own), bucket, "<u4"), np.array([int(a) in twice for a in own], np.uint8)))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 7, pa.int32()), pa.array(sent, pa.binary())], ["part", "data"])
    heard = {(r["bucket"], int(a)) for b in W._answers(iter([batch])) for r in b.to_pylist() for a in W._unpacked(r["data"], "<u8")[0]}
    due = {(b, a) for a, buckets in where.items() for b in buckets if len(buckets) > 1 or a in twice}
    assert due <= heard and len(heard - due) < 300


def test_runs_are_independent_of_their_size(monkeypatch):
    import pyarrow as pa

    texts = pa.array([b" ".join(b"%d" % (k * k % 97) for k in range(n)) for n in (0, 12, 13, 14, 300)], pa.binary())

    def windows():
        out = []
        for run in W._runs(texts, 13, 6):
            at = np.flatnonzero(run.valid)
            out += [(int(run.row[k]), int(run.pos[k]), int(h)) for k, h in zip(at, run.digests(at)[0], strict=True)]
        return sorted(out)

    whole = windows()
    monkeypatch.setattr(W, "AT_ONCE", 20)
    assert windows() == whole and len(whole) == 0 + 0 + 1 + 2 + 288


def test_no_texts(spark):
    assert W.remove_repeats(docs(spark, ROWS).limit(0)).count() == 0


def test_parts_of_one_text_have_all_their_anchors(monkeypatch):
    import pyarrow as pa

    import seriesloom.llm.words as words

    monkeypatch.setattr(words, "PIECE", 100)
    rng = np.random.default_rng(4)
    for _ in range(40):
        text = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 120))
        (whole,) = W._runs(pa.array([text.encode()]), 13, 5)
        n_parts = len(list(words.word_pieces(text.encode())))
        assert n_parts > 3
        monkeypatch.setattr(words, "PIECE", 1 << 22)
        (plain,) = W._runs(pa.array([text.encode()]), 13, 5)
        monkeypatch.setattr(words, "PIECE", 100)
        expected, own = ({int(p): int(a) for p, a in zip(r.pos[r.valid], r.anchors[np.cumsum(r.first) - 1][r.valid], strict=True)} for r in (plain, whole))
        assert own == expected
