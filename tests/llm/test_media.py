"""Image descriptors and the search for edited copies."""

from collections import Counter

import numpy as np

from seriesloom.llm.images import decode_pgm, describe, encode_pgm
from seriesloom.llm.media import DISTANCE, find_copies, near_pairs, tables_of
from seriesloom.llm.pictures import SIDE, drawn, edited, picture


def test_pgm_round_trip_and_damage():
    p = picture([1.0, 2.0])
    assert (decode_pgm(encode_pgm(p)) == p).all()
    assert decode_pgm(b"P5\n# note\n2 1\n255\nab").tolist() == [[97, 98]]
    for bad in (None, b"", b"P6\n1 1\n255\na", b"P5\n9 9\n255\na", b"P5\n0 0\n255\n"):
        assert decode_pgm(bad) is None


def test_small_and_flat_images_have_no_descriptors():
    assert len(describe(np.zeros((64, 64), np.uint8))[0]) == 0
    assert len(describe(np.zeros((3, 5), np.uint8))[0]) == 0


def test_descriptors_are_turned_with_the_image():
    p = picture([3.0])
    there, a = describe(p)
    _, b = describe(np.rot90(p).copy())
    bits = np.unpackbits((a[:, None] ^ b[None]).view(np.uint8), axis=2).sum(axis=2)
    assert (bits.min(axis=1) <= 40).mean() > 0.5


def test_copies_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(8).astype(float).tolist()) for i in range(120)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)] + [(300, None), (None, [1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, id string")
    rows = find_copies(drawn(table), drawn(table.where("vec_id % 4 = 0"), copy=True)).collect()
    out = {r.id: r for r in rows}
    assert len(out) == 152 and Counter(r.id for r in rows)[None] == 1
    asked = {i for i in out if i is not None and i % 4 == 0}
    assert {i for i, r in out.items() if r.asked} == asked
    assert all(r.match is None and r.inliers is None for r in rows if not r.asked)
    assert all(out[200 + i].class_id == 0 for i in range(30))
    hits = len({r.id for r in rows if r.asked and r.match == r.class_id})
    assert hits >= 0.9 * len(asked)
    assert sum(r.match is not None and r.match != r.class_id for r in rows) <= 1
    assert out[None].class_id is None and out[300].class_id == 300


def test_unreadable_images_match_nothing(spark):
    rows = spark.createDataFrame([(1, bytearray(b"no picture")), (2, None), (3, bytearray(encode_pgm(edited(picture([0.5]), 4))))], "id long, image binary")
    out = {r.id: r for r in find_copies(rows, rows).collect()}
    assert out[1].match is None and out[2].match is None and out[2].class_id == 2
    assert out[3].match == 3 and out[3].inliers >= 8
    assert find_copies(rows.limit(0), rows.limit(0)).count() == 0
    assert SIDE > 0


def _scaled(p, factor):
    at = np.minimum(np.arange(int(len(p) * factor)) / factor, len(p) - 1)
    low = np.minimum(at.astype(int), len(p) - 2)
    part = at - low
    rows = p[low] * (1 - part)[:, None] + p[low + 1] * part[:, None]
    return (rows[:, low] * (1 - part) + rows[:, low + 1] * part).astype(np.uint8)


def test_tables_find_what_brute_force_finds():
    noise = np.random.default_rng(5)
    edits = {
        "crop": (0.9, lambda p, i: edited(p, i)),
        "turn": (0.9, lambda p, i: np.rot90(p).copy()),
        "noise": (0.9, lambda p, i: np.clip(p + noise.normal(0, 8, p.shape), 0, 255).astype(np.uint8)),
        "larger": (0.75, lambda p, i: _scaled(p, 1.2)),
        "smaller": (0.75, lambda p, i: _scaled(p, 0.75)),
    }
    pictures = [picture([float(i)]) for i in range(20)]
    for name, (least, edit) in edits.items():
        met = whole = 0
        for i, p in enumerate(pictures):
            there, asked = describe(p)[1], describe(edit(p, i))[1]
            apart = np.bitwise_count(asked[:, None] ^ there[None]).sum(axis=2)
            query, own = near_pairs(asked, tables_of(asked), there)
            assert (apart[query, own] <= DISTANCE).all()
            met, whole = met + len(query), whole + (apart <= DISTANCE).sum()
        assert met >= least * whole, name


def test_turned_scaled_and_noisy_copies_are_found(spark):
    pictures = [picture([float(i)]) for i in range(30)]
    images = spark.createDataFrame([(i, bytearray(encode_pgm(p))) for i, p in enumerate(pictures)], "id long, image binary")
    noise = np.random.default_rng(6)
    for edit in (lambda p: np.rot90(p).copy(), lambda p: _scaled(p, 1.5), lambda p: np.clip(p + noise.normal(0, 8, p.shape), 0, 255).astype(np.uint8)):
        queries = spark.createDataFrame([(i, bytearray(encode_pgm(edit(p)))) for i, p in enumerate(pictures)], images.schema)
        out = find_copies(images, queries).collect()
        assert sum(r.match == r.id for r in out) >= 27
        assert sum(r.match not in (r.id, None) for r in out) <= 1
