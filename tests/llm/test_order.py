"""Mixing and packing."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm.mixing import mix, mixed_rows, pfair, whole_weights
from seriesloom.llm.packing import bin_end, boundaries, pack
from seriesloom.llm.ranks import numbered
from seriesloom.runtime import cut, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot int, __hash string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x") for i, t, s in rows], DOCS)


def fluid(blocks, weights):
    """Blocks that the target has run after 0, 1, ... slots: shares in proportion to the weights, slot by slot, exactly."""
    left, done = [Fraction(n) for n in blocks], [Fraction(0)] * len(blocks)
    out = [list(done)]
    for _ in range(sum(blocks)):
        room = Fraction(1)
        while room > 0:
            active = [s for s, n in enumerate(left) if n > 0]
            total = sum(weights[s] for s in active)
            step = min([room] + [left[s] * total / weights[s] for s in active])
            for s in active:
                left[s] -= step * weights[s] / total
                done[s] += step * weights[s] / total
            room -= step
        out.append(list(done))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([1, 2, 0.3, 2**0.5, 3**0.5, 100, 0.01])), max_size=6))
def test_pfair_keeps_within_one_block_of_the_target(sources):
    blocks, weights = [n for n, _ in sources], whole_weights([w for _, w in sources])
    target, ran = fluid(blocks, weights), [0] * len(blocks)
    for t, (s, k) in enumerate(pfair(blocks, weights), 1):
        assert k == ran[s]
        ran[s] += 1
        assert all(abs(r - f) < 1 for r, f in zip(ran, target[t], strict=True))
    assert ran == blocks


@pytest.mark.parametrize("blocks,weights", [([10**6] * 3, [1, 2**0.5, 3**0.5]), ([10**6, 10**4, 10**6], [1, 1e-4, 2 / 3]), ([400] * 5000, [(k % 977 + 1) ** 0.5 for k in range(5000)])])
def test_no_deviation_adds_up(blocks, weights):
    """A million slots of weights that are no multiples of anything, and many sources."""
    whole = whole_weights(weights)
    total, slots = sum(whole), min(10**6, int(min(n * sum(whole) / w for n, w in zip(blocks, whole, strict=True))))
    last = [0] * len(blocks)
    for t, (s, k) in zip(range(1, slots + 1), pfair(blocks, whole)):
        # Block k runs in the slot that ends at t: begun by the target before t, not completed before t - 1.
        assert k * total < t * whole[s] and (k + 1) * total > (t - 1) * whole[s]
        last[s] = k + 1
    assert sum(last) == slots
    assert all(abs(n * total - slots * w) < total for n, w in zip(last, whole, strict=True))


def test_weights_are_exact():
    assert whole_weights([0.5, 0.25]) == [2, 1] and whole_weights([]) == []
    a, b = whole_weights([2**0.5, 1e-30])
    assert Fraction(a, b) == Fraction(2**0.5) / Fraction(1e-30)


def test_mix_positions_are_the_schedule(spark):
    rows = [(i, "t", "big" if i % 3 else None) for i in range(200)] + [(7, "t", "small"), (7, "t", "small"), (None, None, "small"), (8, "t", "none"), (None, None, "none")]
    docs = documents(spark, rows)
    weights = {"big": 2**0.5, "small": 1, None: 0.7, "absent": 5}
    out = mix(docs, weights, block_rows=4).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in out) == sorted((str(i), str(s)) for i, _, s in rows)
    assert sorted(r.position for r in out) == list(range(len(rows)))
    names = ["big", "none", "small", None]
    sizes = [sum(s == n for _, _, s in rows) for n in names]
    want, first = {}, 0
    for slot, (s, k) in enumerate(pfair([-(-n // 4) for n in sizes], whole_weights([2**0.5, 0.7, 1, 0.7]))):
        want[names[s], k] = (slot, first)
        first += min(4, sizes[s] - 4 * k)
    assert all(r.slot == want[r.source, r.block][0] and 0 <= r.position - want[r.source, r.block][1] < 4 for r in out)
    assert mix(docs.limit(0)).count() == 0


def test_numbers_of_one_key_are_spread(spark):
    rows = spark.range(3000).selectExpr("id as row_no", "if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) as key", "if(id % 2 = 0, 'a', null) as g")
    out = numbered(cut(rows), "g", "key", "row_no", 3000, bucket_rows=10).collect()
    for g in ("a", None):
        assert sorted(r.number for r in out if r.g == g) == list(range(1500))


def test_mixed_rows_keep_every_column_and_row(spark):
    docs = documents(spark, [(i, f"t{i}", f"s{i % 3}") for i in range(100)])
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(100))


def padding(lengths, counts, bounds):
    total = 0
    for n, c in zip(lengths, counts):
        total += (min(b for b in bounds if b >= n) - n) * c
    return total


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 9, replace=False))
        counts = rng.integers(1, 50, 9)
        got = boundaries(lengths, counts, 4)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1].tolist(), 3))
        assert padding(lengths, counts, got) == best and len(got) <= 4
    assert boundaries(np.array([], int), np.array([], int)) == []
    assert boundaries(np.array([5]), np.array([3])) == [5]


def test_pack_fills_batches_within_the_budget(spark):
    rows = [(i, "w " * (i % 37), "s") for i in range(500)] + [(None, None, "s"), (3, "", "s"), (9, "x " * 900, "s")]
    out = pack(documents(spark, rows), buckets=5, budget=200).collect()
    assert len(out) == len(rows)
    batches = {}
    for r in out:
        assert r.n_tokens <= r.padded_length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rs in batches.values():
        assert len({r.place for r in rs}) == len(rs)
        assert len(rs) * rs[0].padded_length <= 200 or len(rs) == 1
    assert len({r.bucket for r in out}) == 5
    assert pack(documents(spark, rows[:1]).limit(0)).count() == 0


def test_long_lengths_lose_little_to_the_bins(spark):
    """Padding beyond EXACT words, against boundaries chosen among all lengths."""
    rng = np.random.default_rng(8)
    lengths, counts = np.unique((rng.pareto(1.2, 3000) * 900 + 1).astype(int), return_counts=True)
    exact = boundaries(lengths, counts, 8)
    ends = np.array([r.e for r in spark.createDataFrame([(int(n),) for n in lengths], "n long").select(bin_end(F.col("n")).alias("e")).collect()])
    bins = np.unique(ends)
    binned = boundaries(np.array([lengths[ends == e].max() for e in bins]), np.array([counts[ends == e].sum() for e in bins]), 8)
    assert padding(lengths, counts, binned) <= 1.01 * padding(lengths, counts, exact)


def test_the_pipeline_packs_in_mixed_order(spark):
    import corpus_pipeline

    rows = [(k, " ".join(["w"] * (1 + 7 * k % 30) + ["x" * (k % 90) * (k > 400)]), "abc"[k * k % 3]) for k in range(600)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    mixed = corpus_pipeline.mixing(spark, docs, "")
    place = {r.doc_id: k for k, r in enumerate(mixed.collect())}
    out = corpus_pipeline.packing(spark, stored(mixed), "").collect()
    assert sorted(r.doc_id for r in out) == list(range(600))
    for bucket in {r.bucket for r in out}:
        own = sorted((r for r in out if r.bucket == bucket), key=lambda r: (r.batch, r.place))
        assert len({(r.batch, r.place) for r in own}) == len(own)
        assert [r.doc_id for r in own] == sorted((r.doc_id for r in own), key=place.get)
