"""The quality network, the language model and the pipeline."""

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import attention as A
from seriesloom.llm import lm, quality
from seriesloom.runtime import cut


def corpus(n=260, seed=0):
    """Clean prose, and junk whose words end in marks."""
    rng = np.random.default_rng(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    rows = []
    for i in range(n):
        words = ["".join(parts[k] for k in rng.integers(0, 10, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(5, 120)))]
        good = i % 4 != 0
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "%%%" for w in words), int(good)))
    return rows


def table(spark, rows):
    return cut(spark.createDataFrame([(i, t, "en", "s", 0, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3))


def test_features_cover_the_whole_text():
    net, seen = quality.fit(quality.fresh(), [(b"good words here", 1), (b"bad%%% words%%%", 0)], 0.01)
    assert seen == 2
    head = b"calm words " * 200
    assert not np.array_equal(quality.features(net, head + b"%%%%%%%% " * 3), quality.features(net, head + b"calm words"))
    assert quality.features(net, b"").shape == (2 * quality.FILTERS,)
    long = bytes(range(256)) * 600
    pools, where = quality._pools(net, quality._padded(long))
    starts = quality._chunk_starts(len(pools))
    assert starts[-1] + quality.POOLS >= len(pools) and all(b - a < quality.POOLS for a, b in zip(starts, starts[1:], strict=False))


def plain_tops(net, text):
    """Each filter's largest answer in each chunk and where it is, place by place."""
    data = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(quality.WIDTH, np.uint8)])
    places = max(1, -(-len(text) // quality.STEP))
    places += -places % quality.POOL
    data = np.concatenate([data, np.zeros(places * quality.STEP + quality.WIDTH - len(data), np.uint8)]) if len(data) < places * quality.STEP + quality.WIDTH else data
    answers = np.array([sum(net.taps[j][data[p * quality.STEP + j]] for j in range(quality.WIDTH)) for p in range(places)])
    pools = places // quality.POOL
    out = []
    for start in range(0, max(1, pools - (quality.POOLS - quality.HOP)), quality.HOP):
        out.append(answers[start * quality.POOL : min(pools, start + quality.POOLS) * quality.POOL].max(axis=0))
    return np.array(out)


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 511, 512, 513, 960, 5000])
def test_chunks_against_a_plain_network(size):
    net = quality.fresh()
    text = bytes(np.random.default_rng(size).integers(32, 127, size).astype(np.uint8))
    tops, where = quality._tops(net, quality._padded(text))
    want = plain_tops(net, text)
    assert np.allclose(tops, want, atol=1e-4)
    on = np.maximum(want + net.bias, 0)
    feature = np.concatenate([on.mean(axis=0), on.max(axis=0)])
    assert abs(quality.probability(net, text) - 1 / (1 + np.exp(-(feature @ net.weights + net.offset)))) < 1e-4


def test_training_follows_the_gradient():
    """One step of a network on one text changes its answer as the numerical gradient says."""
    rng = np.random.default_rng(3)
    net = quality.fresh(1)
    text = bytes(rng.integers(97, 123, 700).astype(np.uint8))
    loss = lambda n: -np.log(quality.probability(n, text))
    before = loss(net)
    for _ in range(3):
        net, _ = quality.fit(net, [(text, 1)], 0.01)
    assert loss(net) < before


def test_quality_is_learned_and_labels_of_the_held_out_fold_are_not_read(spark):
    rows = corpus()
    docs = table(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (3, rows[3][1]), (None, "the the")])
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, 1 - y if fold(i) else y, "z") for i, _, y in rows] + [(5, None, "z"), (None, 1, "z"), (99999, 1, "z")], "doc_id long, quality int, text string")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == fold(r.doc_id) for r in out if r.doc_id is not None)
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth and r.held_out]
    assert np.mean(right) > 0.95 and len(right) > 20
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted)


def test_quality_without_labels(spark):
    docs = table(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, none).collect())
    assert quality.quality_scores(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    m = A.classes(np.concatenate([rng.integers(1, 90, 400).astype(float), [30.0]]), rng.random(401) < 0.5)
    cells = rng.integers(0, 3, A.CLASSES**3).astype(np.float32)
    m = A.with_counts(m, cells, rng.integers(0, 3, (A.CLASSES, A.KNOWN + 1)).astype(np.float32))
    p = A.fresh(3)
    p["group_out"], p["class_out"] = (rng.standard_normal(p[k].shape).astype(np.float32) * 0.3 for k in ("group_out", "class_out"))
    m.params = A.bounded(p)
    return m


END = A.KNOWN + 1  # the code of a text's end


def plain_score(m, codes):
    """One text, one place at a time, with the context its window gives it."""
    total, y = 0.0, m.class_of_code[codes].astype(int)
    for i in range(len(y)):
        first = 0 if i < A.WINDOW else (i - A.WINDOW) // A.STRIDE * A.STRIDE + A.STRIDE
        x = np.array([[END if j == 0 else codes[j - 1] for j in range(first, i + 1)]])
        h = A._attend(m.params, x, 0)[0, -1].astype(float)
        context = (y[i - 2] if i > 1 else 0) * A.CLASSES + (y[i - 1] if i else 0)
        g, c = y[i] >> 4, y[i] & 15
        for out, row, k in ((m.params["group_out"], m.by_group[context], g), (m.params["class_out"][g], m.by_class[context, g], c)):
            s = h @ out.astype(float) - row * float(A.GRAIN)
            total += s[k] - math.log(np.exp(s).sum())
    return total / math.log(10)


def some_codes(m, rng, n):
    return np.append(m.code_of[rng.integers(0, 400, n - 1)], END).astype(np.uint16)


def test_scores_are_those_of_one_place_at_a_time(model):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 2, A.WINDOW, A.WINDOW + 1, A.WINDOW + A.STRIDE, 3 * A.WINDOW + 7, 1])
    texts = [some_codes(model, rng, n) for n in sizes]
    found = A.text_scores(model, np.concatenate(texts), sizes)
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=2e-3)


def test_windows_cover_every_text(model):
    rng = np.random.default_rng(2)
    sizes = np.array([1, 31, 32, 33, 100, 1, 64])
    texts = [some_codes(model, rng, n) for n in sizes]
    text, turn, windows = lm._windows(np.concatenate(texts), sizes)
    for k, t in enumerate(texts):
        mine = windows[text == k]
        assert turn[text == k].tolist() == list(range(-(-len(t) // A.WINDOW)))
        real = mine[:, 2:].reshape(-1)
        assert (real[: len(t)] == t).all() and (real[len(t) :] == A.PAD).all()
        before = np.concatenate([[END, END], t])
        assert all((w[:2] == before[A.WINDOW * n : A.WINDOW * n + 2]).all() for n, w in enumerate(mine))


def test_gradients_are_the_numeric_ones(model):
    rng = np.random.default_rng(6)
    windows = lm._windows(some_codes(model, rng, 75), np.array([75]))[2]
    sizes = np.array([32, 32, 11])
    params = {k: v.astype(np.float64) for k, v in model.params.items()}

    def loss(p):
        total = 0.0
        for w, n in zip(windows, sizes, strict=True):
            y = model.class_of_code[np.where(w == A.PAD, END, w)].astype(int)
            x = np.where(w == A.PAD, END, w)[None, 1:-1]
            h = A._attend(p, x, 0)[0]
            for i in range(n):
                context, target = y[i] * A.CLASSES + y[i + 1], y[i + 2]
                for out, row, k in ((p["group_out"], model.by_group[context], target >> 4), (p["class_out"][target >> 4], model.by_class[context, target >> 4], target & 15)):
                    s = h[i] @ out - row * float(A.GRAIN)
                    total -= s[k] - math.log(np.exp(s).sum())
        return total / sizes.sum()

    found = A.gradients(model, model.params, windows)
    used = int(windows[0, 5])
    for name, at in (("query", (used, 3)), ("key", (used, 0)), ("value", (used, 7)), ("query_at", (4, 2)), ("key_at", (2, 2)), ("group_out", (5, 3)), ("class_out", (int(model.class_of_code[used]) >> 4, 2, 5))):
        ends = []
        for step in (1e-4, -1e-4):
            p = {k: v.copy() for k, v in params.items()}
            p[name][at] += step
            ends.append(loss(p))
        assert abs((ends[0] - ends[1]) / 2e-4 - found[name][at]) < 2e-4 + 0.02 * abs(found[name][at]), name


def test_probabilities_add_up(model):
    h = np.repeat(np.random.default_rng(2).standard_normal((1, A.WIDTH)).astype(np.float32), A.CLASSES, axis=0)
    total = 10.0 ** A.log_probs(model, h, np.full(A.CLASSES, 77), np.arange(A.CLASSES))
    assert abs(total.sum() - 1) < 1e-3
    ids = np.arange(len(model.class_of))
    for last in (0, 9):
        share = np.bincount(model.class_of, 10.0 ** A.id_shares(model, ids, np.full(len(ids), last)), A.CLASSES)
        assert share.max() < 1 + 1e-3


def test_training_lowers_the_loss(model):
    rng = np.random.default_rng(5)
    pattern = np.tile(model.code_of[[5, 40, 200, 7, 90]], 20)
    windows = np.stack([np.concatenate([[END, END], np.roll(pattern, -int(k))[: A.WINDOW]]) for k in rng.integers(0, 5, 3000)]).astype(np.uint16)
    y, sizes = np.tile(np.append(pattern[:40], END).astype(np.uint16), 4), np.full(4, 41)
    before = A.text_scores(model, y, sizes).sum()
    trained = A.train(model, model.params, windows, rate=0.02)
    old, model.params = model.params, A.bounded(trained)
    after = A.text_scores(model, y, sizes).sum()
    model.params = old
    assert after > before


def test_words_at_once_are_words_one_by_one():
    with open(lm.VOCABULARY, "rb") as f:
        encode = lm.Subwords(f.read())
    words = ["the", "%%%", "don't", "été", " x", "x ", "日本", "a" * 500, "1234", "_"]
    for some in (words, words[:4], ["x ", "y"]):
        raw = [w.encode() for w in some]
        ids, sizes = encode.many(raw)
        assert ids.tolist() == [i for w in raw for i in encode(w)] and sizes.tolist() == [len(encode(w)) for w in raw]


def test_lm_base_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "RARE_HELD", 300)
    monkeypatch.setattr(lm, "WORDS_HELD", 200)
    monkeypatch.setattr(lm, "HEAVY_BITS", 7)
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    rows = [(i, t) for i, t, _ in corpus(120)] + [(500, None), (501, ""), (502, "The\u000bTHE   x"), (None, "the er"), (7, "again")]
    out = lm.lm_scores(table(spark, rows)).collect()
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not fold(i):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((str(i), fold(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm.lm_scores(table(spark, rows[:3]).limit(0)).count() == 0


def test_driver_gets_one_mean_a_round_and_sends_the_tables_once(spark, monkeypatch):
    docs = table(spark, [(i, t) for i, t, _ in corpus(120)])
    monkeypatch.setattr(lm, "SHARD_WINDOWS", 16)
    fetched, sent = [], []
    collect, broadcast = type(docs).collect, type(spark.sparkContext).broadcast

    def collected(df):
        rows = collect(df)
        if "weights" in df.columns:
            fetched.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", collected)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(len(pickle.dumps(value))) or broadcast(sc, value))
    with open(lm.VOCABULARY, "rb") as f:
        data = broadcast(spark.sparkContext, f.read())
    params = []
    for at_once in (64, 2):  # all shards at once, or means of means
        monkeypatch.setattr(lm, "SUM_SHARDS", at_once)
        shards = []
        monkeypatch.setattr(lm, "cut", lambda df, shards=shards: (out := cut(df), shards.append(out.count()))[0])
        params.append(lm.fit(docs, "doc_id", "text", data)[1])
        assert max(shards) > 4
    assert fetched == [1] * (2 * lm.ROUNDS)
    assert sum(size > 1 << 24 for size in sent) == 2
    assert all(np.allclose(params[0][k], params[1][k], atol=1e-4) for k in A.NAMES)


def test_tally_counts_past_two_bytes():
    """Two bytes a cell: the whole table of class trigrams takes 33 MB of a worker."""
    rng = np.random.default_rng(4)
    runs = [np.concatenate([rng.integers(0, 200_000, 5000), np.full(n, 7), np.full(90_000, 70_000), np.full(65_535, 8)]) for n in (65_536, 1, 40_000, 40_000)]
    tally = lm.Tally(200_000)
    for cells in runs:
        tally.add(cells.astype(np.int32))
    found = np.zeros(200_000 + (1 << 16), np.int64)
    for chunk, at, n in tally.chunks():
        assert len(np.unique(at)) == len(at) and at.min() >= 0 and at.max() < 1 << lm.CHUNK_BITS
        found[(chunk << lm.CHUNK_BITS) + at] += n.astype(np.int64)
    assert (found[:200_000] == np.bincount(np.concatenate(runs), minlength=200_000)).all()
    assert tally.room.itemsize == 2


def test_mean_of_shards_weighs_their_windows():
    weights = [np.full(3, x, "<f4").tobytes() for x in (4.0, 1.0)]
    out = lm._sum_group(pa.table({"shard": pa.array([0, 0], pa.int32()), "k": pa.array([1, 0], pa.int32()), "n": [1, 2], "weights": weights}))
    assert out.column("n").to_pylist() == [3] and np.frombuffer(out.column("weights")[0].as_py(), "<f4").tolist() == [2.0] * 3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(160, 3)
    long = " ".join(f"word{k}" for k in range(200))
    texts = [(i, t) for i, t, _ in rows] + [(900, long), (901, long.upper()), (902, long + " end"), (903, None)]
    table(spark, texts).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen
        seen = now
    assert {i for i, _, y in rows if y and len(_) > 200} <= seen and len({900, 901, 902} & seen) == 1
    assert sum(1 for i, _, y in rows if not y and i in seen) <= 3
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in final) == sorted(seen)


def test_scores_do_not_depend_on_files(spark):
    rows = [(i, t) for i, t, _ in corpus(60, 8)] + [(None, "without an id"), (2**63 - 1, "largest id"), (70, "x" * 300), (71, "x" * 300 + " " + "y" * 90)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((str(r.doc_id), round(r.score, 3), r.n_known) for r in lm.lm_scores(cut(x)).collect()) for x in (one.coalesce(1), one.repartition(4)))
    assert [x[::2] for x in a] == [x[::2] for x in b]
    assert all(abs(x[1] - y[1]) <= 0.01 * abs(x[1]) for x, y in zip(a, b, strict=True))
    assert {"None", str(2**63 - 1)} <= {x[0] for x in a}


def test_attention_sees_eight_earlier_classes_or_more():
    assert A.WINDOW >= 32 and A.WIDTH >= 16
    assert A.WINDOW - A.STRIDE >= 8
