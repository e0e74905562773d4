"""A causal self-attention language model over subword ids, in numpy.

One causal attention head looks at the window's earlier ids: each of the KNOWN
most frequent ids has vectors of its own, the others share their class's. It
predicts the next id in three steps, on top of tables counted over the whole
training corpus: which of GROUPS groups of classes, which class of the group
(both against class trigrams), and which id of the class, given the class before.

    P(id | past)           = P(group | past) * P(class | group, past) * P(id | class, last class)
    P(group | past)        ~ trigram[last two classes][group] * exp(attention(past) @ group_out[:, group])
    P(class | group, past) ~ trigram[last two classes][class] * exp(attention(past) @ class_out[group][:, class])
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Positions of a window, those scored in a window that continues a text, numbers a head works with.
WINDOW, STRIDE, WIDTH = 32, 24, 16
#: Classes; those that frequent ids have to themselves. Class 0 is the end of a text, the rest share the other ids.
CLASSES, SINGLE = 256, 215
#: Groups of classes: class >> 4.
GROUPS = 16
#: Most frequent ids that are also counted by the class before them, and have vectors of their own.
KNOWN = 4095
#: An id's code: its place among the KNOWN, or KNOWN + 1 + its class. PAD stands after the end of a text that does not fill its window.
CODES, PAD = KNOWN + 1 + CLASSES, (1 << 16) - 1
#: Windows attended to at once; windows whose classes are looked up at once.
BATCH, MANY = 32, 512
#: Largest exponent that the attention may reach; keeps float32 exponentials finite.
LIMIT = 30.0
#: The trained tables, in the order in which they are averaged.
NAMES = ("query", "key", "value", "query_at", "key_at", "group_out", "class_out")
#: Taken from each count above zero.
DISCOUNT = 0.8
#: Causal: position i sees inputs up to i.
MASK = np.tri(WINDOW, dtype=np.float32)
#: The trigram tables hold -log P in steps of GRAIN, up to 255 of them.
GRAIN = np.float32(14 / 255)


@dataclass
class Model:
    class_of: np.ndarray  # (ids,) uint8; the last id is the end of a text
    share: np.ndarray  # (ids,) float32: log10 P(id | class) without context
    column: np.ndarray  # (ids,) int16: place among the KNOWN ids, 0 for others
    code_of: np.ndarray  # (ids,) uint16
    class_of_code: np.ndarray  # (CODES,) uint8
    by_group: np.ndarray | None = None  # (CLASSES ** 2, GROUPS) uint8, by last but one class and last class
    by_class: np.ndarray | None = None  # (CLASSES ** 2, GROUPS, CLASSES // GROUPS) uint8, in each group
    given: np.ndarray | None = None  # (CLASSES, KNOWN + 1) float32: log10 P(id | class, last class)
    rest: np.ndarray | None = None  # (CLASSES, CLASSES) float32, by last class and class: log10 of the part that other ids share
    params: dict = field(default_factory=dict)


def classes(counts: np.ndarray, begins_word: np.ndarray) -> Model:
    """Classes from the corpus counts of all ids; the last id ends a text and has class 0."""
    n = len(counts) - 1
    out = np.zeros(n + 1, np.uint8)
    order = np.lexsort((np.arange(n), -counts[:n]))
    single = min(SINGLE, n)
    out[order[:single]] = 1 + np.arange(single)
    groups = (CLASSES - 1 - single) // 2
    rest = order[single:]
    for first, members in ((1 + single, rest[begins_word[rest]]), (1 + single + groups, rest[~begins_word[rest]])):
        mass = np.cumsum(counts[members] + 1.0)
        if len(mass):  # equal steps of the square root of the mass, so that rare ids do not share a class with common ones
            out[members] = first + np.minimum((np.sqrt(mass / mass[-1]) * groups).astype(int), groups - 1)
    total = np.bincount(out, weights=counts + 1.0, minlength=CLASSES)
    column = np.zeros(n + 1, np.int16)
    column[order[:KNOWN]] = 1 + np.arange(min(KNOWN, n))
    codes = np.where(column > 0, column, KNOWN + 1 + out.astype(np.int32)).astype(np.uint16)
    class_of_code = np.concatenate([np.zeros(KNOWN + 1, np.uint8), np.arange(CLASSES, dtype=np.uint8)])
    class_of_code[codes] = out
    return Model(out, np.log10((counts + 1.0) / total[out]).astype(np.float32), column, codes, class_of_code)


def with_counts(model: Model, trigrams: np.ndarray, given: np.ndarray) -> Model:
    """Tables from corpus counts: trigrams (CLASSES ** 3 cells) and given (CLASSES x KNOWN + 1, the id in a column after a class).

    Absolute discounting: what is taken from each seen cell goes to the next
    shorter context, where a cell counts by how many longer ones it is seen in.
    """
    t = trigrams.reshape(CLASSES, CLASSES, CLASSES)
    pairs = t.sum(axis=0, dtype=np.float64)  # (last, next)
    plain = ((pairs > 0).sum(axis=0) + 0.5) / ((pairs > 0).sum() + 0.5 * CLASSES)
    two = _discounted((t > 0).sum(axis=0).astype(np.float64), plain, DISCOUNT - 0.1)
    model.by_group = np.empty((CLASSES * CLASSES, GROUPS), np.uint8)
    model.by_class = np.empty((CLASSES * CLASSES, GROUPS, CLASSES // GROUPS), np.uint8)
    for a in range(CLASSES):
        p = _discounted(t[a].astype(np.float64), two, DISCOUNT).reshape(CLASSES, GROUPS, -1)
        whole = p.sum(axis=2, keepdims=True)
        at = slice(a * CLASSES, (a + 1) * CLASSES)
        model.by_group[at] = np.minimum(np.round(-np.log(whole[:, :, 0] / whole.sum(axis=1)) / GRAIN), 255)
        model.by_class[at] = np.minimum(np.round(-np.log(p / whole) / GRAIN), 255)
    known = np.flatnonzero(model.column)
    share, group = np.ones(KNOWN + 1), np.zeros(KNOWN + 1, np.int64)
    share[model.column[known]], group[model.column[known]] = 10.0 ** model.share[known], model.class_of[known]
    kinds = np.zeros((CLASSES, CLASSES))
    np.add.at(kinds.T, group[1:], (given[:, 1:] > 0).T)
    spare = (DISCOUNT * kinds + 1.0) / (pairs + 1.0)
    model.rest = np.log10(np.minimum(spare, 1.0)).astype(np.float32)
    seen = np.maximum(given - DISCOUNT, 0) / (pairs[:, group] + 1.0)
    model.given = np.log10(seen + 10.0 ** model.rest[:, group] * share).astype(np.float32)
    return model


def _discounted(counts: np.ndarray, shorter: np.ndarray, discount: float) -> np.ndarray:
    kinds = (counts > 0).sum(axis=-1, keepdims=True)
    return (np.maximum(counts - discount, 0) + (discount * kinds + 1e-3) * shorter) / (counts.sum(axis=-1, keepdims=True) + 1e-3)


def id_shares(model: Model, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log10 P(id | class, last class) of each id."""
    column = model.column[ids]
    return np.where(column > 0, model.given[last, column], model.share[ids] + model.rest[last, model.class_of[ids]])


def fresh(seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    table = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return {"query": table(CODES, WIDTH), "key": table(CODES, WIDTH), "value": table(CODES, WIDTH), "query_at": table(WINDOW, WIDTH), "key_at": table(WINDOW, WIDTH), "group_out": np.zeros((WIDTH, GROUPS), np.float32), "class_out": np.zeros((GROUPS, WIDTH, CLASSES // GROUPS), np.float32)}


def bounded(p: dict) -> dict:
    """Scaled down, where needed, so that what the attention adds cannot pass LIMIT."""
    p = {k: v.copy() for k, v in p.items()}
    for name in ("group_out", "class_out"):
        reach = np.abs(p[name]).sum(axis=-2).max() * np.abs(p["value"]).max()
        if reach > LIMIT:
            p[name] *= np.float32(LIMIT / reach)
    return p


def _attend(p: dict, x: np.ndarray, lo: int, parts: bool = False) -> np.ndarray | tuple[np.ndarray, ...]:
    """Masked attention of the positions lo.. of each window of codes over themselves and earlier ones; parts: with all that led to it."""
    n = x.shape[1]
    q, k, v = p["query"][x[:, lo:]] + p["query_at"][lo:n], p["key"][x] + p["key_at"][:n], p["value"][x]
    w = q @ k.transpose(0, 2, 1)
    np.exp(np.clip(w, -LIMIT, LIMIT, out=w), out=w)
    w *= MASK[lo:n, :n]
    total = w @ np.ones((n, 1), np.float32)
    if not parts:
        return (w @ v) / total
    w /= total
    return q, k, v, w, w @ v


def _log_share(score: np.ndarray, table: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of the target column's share of exp(score) * table; score is overwritten."""
    score -= table * GRAIN
    own = score[np.arange(len(score)), target]
    np.exp(score, out=score)
    return own - np.log(score @ np.ones(score.shape[1], np.float32))


def log_probs(model: Model, h: np.ndarray, context: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log10 P(y) of places with attention h (places, WIDTH) and the two classes before."""
    p = model.params
    group, within = y >> 4, y & 15
    out = _log_share(h @ p["group_out"], model.by_group[context], group)
    order = np.argsort(group.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        at = order[bounds[g] : bounds[g + 1]]
        if len(at):
            out[at] += _log_share(h[at] @ p["class_out"][g], model.by_class[context[at], g], within[at])
    return out * np.float32(np.log10(np.e))


def text_scores(model: Model, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 P of each text's classes. codes: the texts' codes one after the other, each with its end (class 0).

    Windows overlap by WINDOW - STRIDE positions, and each position is scored
    once: in a text's first window all of them, in the others the last STRIDE.
    """
    begins = np.cumsum(sizes) - sizes
    y = model.class_of_code[codes].astype(np.int32)
    x = np.empty(len(y), np.uint16)
    x[1:] = codes[:-1]
    x[begins] = KNOWN + 1  # an end
    context = np.zeros(len(y), np.int32)
    context[2:] = y[:-2] * CLASSES
    context[begins] = 0
    context[(begins + 1)[sizes > 1]] = 0
    context[1:] += np.where(x[1:] == KNOWN + 1, 0, y[:-1])
    p = model.params
    out = np.zeros(len(sizes))
    more = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), more)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(more) - more, more) + 1
    for lo, owner, first in ((0, np.arange(len(sizes)), np.zeros(len(sizes), np.int64)), (WINDOW - STRIDE, doc, turn * STRIDE)):
        for a in range(0, len(owner), MANY):
            d = owner[a : a + MANY]
            size = sizes[d][:, None]
            width = min(WINDOW, int((size - first[a : a + MANY, None]).max()))  # short texts need no whole window
            pos = first[a : a + MANY, None] + np.arange(width)
            at = begins[d][:, None] + np.minimum(pos, size - 1)
            inputs = x[at]
            h = np.concatenate([_attend(p, inputs[k : k + BATCH], lo) for k in range(0, len(d), BATCH)])
            real, at = pos[:, lo:] < size, at[:, lo:]
            whole = np.zeros(real.shape, np.float32)
            if real.all():
                whole[:] = log_probs(model, h.reshape(-1, WIDTH), context[at].reshape(-1), y[at].reshape(-1)).reshape(real.shape)
            else:
                at = at[real]
                whole[real] = log_probs(model, h[real], context[at], y[at])
            out += np.bincount(d, weights=whole.sum(axis=1, dtype=np.float64), minlength=len(sizes))
    return out


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """(size, width): the sum of the rows at each place."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def gradients(model: Model, p: dict, part: np.ndarray) -> dict:
    """Of the mean loss over the real positions of windows of codes (windows, WINDOW + 2)."""
    real = part[:, 2:] != PAD
    part = np.where(part == PAD, KNOWN + 1, part)
    y = model.class_of_code[part].astype(np.int32)
    x, context, y = part[:, 1:-1], (y[:, :-2] * CLASSES + y[:, 1:-1]).reshape(-1), y[:, 2:].reshape(-1)
    q, k, v, w, h = _attend(p, x, 0, parts=True)
    flat = h.reshape(-1, WIDTH)
    weight = (real.reshape(-1, 1) / max(1, real.sum())).astype(np.float32)
    group, within = y >> 4, y & 15
    error = _errors(flat @ p["group_out"], model.by_group[context], group) * weight
    dh = error @ p["group_out"].T
    grads = {"group_out": flat.T @ error, "class_out": np.zeros_like(p["class_out"])}
    order = np.argsort(group.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        at = order[bounds[g] : bounds[g + 1]]
        if len(at):
            some = flat[at]
            error = _errors(some @ p["class_out"][g], model.by_class[context[at], g], within[at]) * weight[at]
            dh[at] += error @ p["class_out"][g].T
            grads["class_out"][g] = some.T @ error
    dh = dh.reshape(h.shape)
    dv = w.transpose(0, 2, 1) @ dh
    dw = dh @ v.transpose(0, 2, 1)
    dw -= (dh * h).sum(axis=2, keepdims=True)
    dw *= w
    dq, dk = dw @ k, dw.transpose(0, 2, 1) @ q
    grads |= {"query_at": dq.sum(axis=0), "key_at": dk.sum(axis=0)}
    sums = _summed(np.concatenate([dq, dk, dv], axis=2).reshape(-1, 3 * WIDTH), x.reshape(-1), CODES)
    return grads | {name: sums[:, i * WIDTH : (i + 1) * WIDTH] for i, name in enumerate(("query", "key", "value"))}


def train(model: Model, start: dict, windows: np.ndarray, rate: float = 0.004, batch: int = 256) -> dict:
    """One pass of Adam over windows of codes (windows, WINDOW + 2); columns 0 and 1 are the codes before the window."""
    p = {k: v.copy() for k, v in start.items()}
    slow, fast = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step, a in enumerate(range(0, len(windows), batch), 1):
        size = rate * min(1, step / 10)
        for name, g in gradients(model, p, windows[a : a + batch]).items():
            m, v = slow[name], fast[name]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p[name] -= np.float32(size / (1 - 0.9**step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-6))
    return p


def _errors(score: np.ndarray, table: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Shares minus one for the target: the gradient of a softmax over exp(score) * table."""
    share = np.exp(np.clip(score, -LIMIT, LIMIT) - table * GRAIN)
    share /= share.sum(axis=1, keepdims=True)
    share[np.arange(len(share)), target] -= 1
    return share
