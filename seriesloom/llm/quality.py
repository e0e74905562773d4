"""Document quality by a byte-level convolutional network in numpy.

A document's bytes are read in overlapping chunks that cover it from end to
end. Learned filters slide over every chunk; each filter's largest answer in a
chunk is kept (max pooling), and the mean and the maximum of these over all
chunks are combined by a logistic unit into one probability.

Training looks at a bounded sample of the labelled rows, at most `per_class`
documents of each label, chosen by a hash of doc_id, and at every byte of each,
in the same chunks that are scored. It goes round by round: a fixed number of
tasks, each with the documents of its hash, take a pass of Adam steps from the
same weights, which are averaged; no text reaches the driver, and a task holds a
batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.text import as_bytes
from seriesloom.runtime import cut, stored

#: Bytes that a filter sees, bytes between two places where it looks, filters.
WIDTH, STEP, FILTERS = 8, 2, 24
#: A chunk has POOLS pools of POOL places; the next one begins HOP pools later.
POOL, POOLS, HOP = 16, 16, 14
#: Places whose answers are in memory at once (a multiple of POOL).
PLACES = 4096
#: Labelled documents of each kind that training sees at most; tasks of a round at most; rounds; documents of an Adam step.
PER_CLASS, SHARDS, ROUNDS, BATCH = 2500, 4, 10, 8
#: Documents for a task; documents that a round goes through, a small sample several times.
TASK_ROWS, ROUND_ROWS = 500, 800
#: Adam's step in the first round; it falls to nothing over the rounds.
RATE = 0.01
THRESHOLD = 0.3


@dataclass
class Network:
    """taps[j][byte]: what byte j of a place adds to the filters."""

    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float


def _padded(text: bytes) -> np.ndarray:
    """The bytes, filled up with zeros to whole pools of places."""
    places = max(1, -(-len(text) // STEP))
    places += -places % POOL
    out = np.zeros(places * STEP + WIDTH - STEP, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def _pools(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pools, FILTERS), twice: each filter's largest answer in each pool of the whole padded text, and its place."""
    places = (len(data) - WIDTH + STEP) // STEP
    top = np.empty((places // POOL, net.taps.shape[2]), np.float32)
    where = np.empty(top.shape, np.int64)
    for at in range(0, places, PLACES):
        n = min(PLACES, places - at)
        part = data[at * STEP : (at + n) * STEP + WIDTH - STEP]
        answer = net.taps[0][part[: n * STEP : STEP]]
        for j in range(1, WIDTH):
            answer += net.taps[j][part[j : j + (n - 1) * STEP + 1 : STEP]]
        answer = answer.reshape(n // POOL, POOL, -1)
        rows = slice(at // POOL, (at + n) // POOL)
        where[rows] = answer.argmax(axis=1) + (at + np.arange(n // POOL) * POOL)[:, None]
        top[rows] = answer.max(axis=1)
    return top, where


def _chunk_starts(pools: int) -> np.ndarray:
    return np.arange(0, max(1, pools - (POOLS - HOP)), HOP)


def _tops(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, FILTERS), twice: the largest answers in the overlapping chunks of the padded text, and their places."""
    top, where = _pools(net, data)
    starts = _chunk_starts(len(top))
    chunk = np.minimum(starts[:, None] + np.arange(POOLS), len(top) - 1)
    best = chunk[np.arange(len(starts))[:, None], top[chunk].argmax(axis=1)]
    column = np.arange(top.shape[1])
    return top[best, column], where[best, column]


def features(net: Network, text: bytes) -> np.ndarray:
    """(2 * FILTERS,): mean and maximum over the chunks of the rectified largest answers."""
    tops = np.maximum(_tops(net, _padded(text))[0] + net.bias, 0)
    return np.concatenate([tops.mean(axis=0), tops.max(axis=0)])


def probability(net: Network, text: bytes) -> float:
    return float(1 / (1 + np.exp(-np.clip(features(net, text) @ net.weights + net.offset, -30, 30))))


def fresh(seed: int = 7, filters: int = FILTERS) -> Network:
    rng = np.random.default_rng(seed)
    taps = (rng.standard_normal((WIDTH, 256, filters)) * 0.25).astype(np.float32)
    return Network(taps, np.zeros(filters, np.float32), (rng.standard_normal(2 * filters) * 0.2).astype(np.float32), 0.0)


def fit(start: Network, documents: Iterator[tuple[bytes, int]], rate: float, batch: int = BATCH) -> tuple[Network, int]:
    """(network, documents seen) after a pass of Adam steps over (text, label) pairs."""
    net = Network(start.taps.copy(), start.bias.copy(), start.weights.copy(), start.offset)
    filters = net.taps.shape[2]
    params = [net.taps, net.bias, net.weights, np.full(1, start.offset, np.float32)]
    slow, fast = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    column = np.arange(filters)
    step, seen = 0, 0
    documents = iter(documents)
    while lot := list(islice(documents, batch)):
        grads = [np.zeros_like(p) for p in params]
        for text, y in lot:
            data = _padded(text)
            top, where = _tops(net, data)
            top += net.bias
            on = np.maximum(top, 0)
            feature = np.concatenate([on.mean(axis=0), on.max(axis=0)])
            p = 1 / (1 + np.exp(-np.clip(feature @ net.weights + params[3][0], -30, 30)))
            g = np.float32((p - y) / len(lot))
            grads[2] += g * feature
            grads[3] += g
            down = np.repeat(g * net.weights[None, :filters] / len(top), len(top), axis=0)
            down[on.argmax(axis=0), column] += g * net.weights[filters:]
            down *= top > 0
            grads[1] += down.sum(axis=0)
            for j in range(WIDTH):
                np.add.at(grads[0][j], (data[where * STEP + j], column), down)
        seen += len(lot)
        step += 1
        for p, g, m, v in zip(params, grads, slow, fast, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * min(1, step / 10) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.offset = float(params[3][0])
    return net, seen


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([net.taps.reshape(-1), net.bias, net.weights, [net.offset]]).astype(np.float64)


def _network(flat: np.ndarray, filters: int = FILTERS) -> Network:
    n = WIDTH * 256 * filters
    x = flat.astype(np.float32)
    return Network(x[:n].reshape(WIDTH, 256, filters), x[n : n + filters], x[n + filters : n + 3 * filters], float(flat[-1]))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is learned from; false for a null doc_id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pass(batches: Iterator[pa.RecordBatch], net: Broadcast, rate: float) -> Iterator[pa.RecordBatch]:
    """The weights of each shard after a pass over its documents; rows (shard, text, y) come sorted by shard."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True))
    for shard, part in groupby(rows, lambda row: row[0]):
        found, seen = fit(net.value, ((t.as_py(), y) for _, t, y in part), rate)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seen]), pa.array([_flat(found).tobytes()], pa.binary())], ["shard", "seen", "weights"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, rounds: int = ROUNDS) -> Network:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    Of rows with one doc_id, the least text is learned from; a doc_id with both
    labels counts for both. With labels of one kind only, or none, the network
    answers their share.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).distinct()
    known = known.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi")
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    ids = cut(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows at most
    counts = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    net = fresh()
    if len(counts) < 2:
        net.weights[:] = 0
        net.offset = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
        return net
    texts = docs.select(F.col(doc_id).alias("id"), as_bytes(F.col(text)).alias("text")).join(F.broadcast(ids.select("id").distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    sample = stored(texts.join(ids, "id"), "labelled")
    size = sum(counts.values())
    shards, passes = max(1, min(SHARDS, size // TASK_ROWS)), -(-ROUND_ROWS // size)
    shard, sc = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), docs.sparkSession.sparkContext
    for k in range(rounds):
        shared = sc.broadcast(net)  # a fixed size: 8 * 256 * FILTERS numbers
        rate = RATE * (1 - k / rounds)
        dealt = sample.withColumn("shard", shard).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(passes)))).repartition(shards, "shard")
        dealt = dealt.sortWithinPartitions("shard", "turn", F.xxhash64("id", F.lit(k), "turn"), "id", "y").select("shard", "text", "y")
        found = dealt.mapInArrow(lambda it, shared=shared, rate=rate: _pass(it, shared, rate), "shard int, seen long, weights binary").collect()  # SHARDS rows at most
        parts = [(r.seen, bytes(r.weights)) for r in sorted(found)]
        net = _network(sum(n * np.frombuffer(w) for n, w in parts) / sum(n for n, _ in parts))
        shared.unpersist()
    return net


def _scores(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [probability(net, t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **sample: int) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold): one row per input row.

    A null text scores as the empty text. Labels that are null or neither 0
    nor 1, and labels of no document, are not learned from; without usable
    labels of both kinds the score is the share of ones.
    """
    net = train(docs, labels, doc_id, text, **sample)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: 8 * 256 * FILTERS numbers
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(F.col(text)).alias("text")).mapInArrow(lambda it: _scores(it, shared.value), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with a score of at least the threshold, all columns kept; the text is not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [probability(shared.value, (t.as_py() or "").encode()) >= threshold for t in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
