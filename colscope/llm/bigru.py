"""Bidirectional gated recurrent network with attention pooling, in numpy: forward pass, gradients, training.

A word's input is the sum of a word embedding (hashed) and the mean of the embeddings of its byte trigrams
(hashed); the product with the input weights is formed once per distinct word.  Both directions run in
one loop over the positions of a batch of windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Embedding width, units per direction, buckets of words and of trigrams.
WIDTH, UNITS, WORD_BUCKETS, CHAR_BUCKETS = 16, 8, 1 << 14, 1 << 13
#: Windows per batch in training and in scoring.
TRAIN_BATCH, SCORE_BATCH = 256, 1024
EPOCHS, RATE = 8, 0.01
#: Small samples are gone through more often, until there were so many steps.
MIN_STEPS = 400
#: Initial scale of trigram embeddings; share of words hidden in training; decay of embeddings per step.
CHAR_SCALE, HIDDEN, DECAY = 0.2, 0.1, 2e-3
_STRIP = b".,;:!?\"'()[]{}|#$%&*<>-_"


class Types(dict):
    """Numbers distinct words in the order of their first occurrence; number 0 is the padding."""

    def __init__(self) -> None:
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


@dataclass
class WordFeatures:
    """Hashed word and trigrams of each type."""

    word: np.ndarray
    chars: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def word_features(types: list[bytes]) -> WordFeatures:
    bare = [w.strip(_STRIP) or w or b"\0" for w in types]
    word = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in bare), dtype=np.int64, count=len(bare))
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in bare), dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in bare), dtype=np.int64, count=len(bare))
    ends = np.cumsum(sizes)
    h = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + data[2:] * np.uint32(0x27D4EB2F)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = sizes - 2
    inside = np.ones(len(h), dtype=bool)
    inside[(ends[:-1] - 1)] = inside[(ends[:-1] - 2)] = False
    return WordFeatures(word, ((h >> np.uint32(8)) % np.uint32(CHAR_BUCKETS))[inside].astype(np.int64), np.cumsum(counts) - counts, counts)


def windows_of(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    return np.array([0]) if n <= WINDOW else np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    #: Of the calibrated score: slope and intercept on the highest window's logit, and the score of texts without words.
    slope: float = 1.0
    intercept: float = 0.0
    empty: float = 0.0
    _moments: dict = field(default_factory=dict)

    def inputs(self, features: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
        """(embedding, product with the input weights) of every type."""
        w = self.weights
        x = w["word"][features.word] + np.add.reduceat(w["char"][features.chars], features.starts, axis=0) / features.counts[:, None].astype(np.float32)
        return x, x @ w["in"] + w["in_bias"]


def new_model(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model({
        "word": np.zeros((WORD_BUCKETS, WIDTH), np.float32), "char": normal(CHAR_BUCKETS, WIDTH, scale=CHAR_SCALE),
        "in": normal(WIDTH, 6 * UNITS, scale=WIDTH ** -0.5), "in_bias": np.zeros(6 * UNITS, np.float32),
        "state": normal(2, UNITS, 3 * UNITS, scale=UNITS ** -0.5), "attend": normal(2 * UNITS, scale=0.1),
        "out": normal(2 * UNITS, scale=0.3), "bias": np.zeros(1, np.float32)})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(weights: dict[str, np.ndarray], product: np.ndarray, numbers: np.ndarray, mask: np.ndarray | None, trace: bool = False):
    """Logits of a batch; numbers: (batch, positions); mask: 1 where a word stands, None if everywhere."""
    batch, steps = numbers.shape
    u = UNITS
    x = product.reshape(-1, 2, 3 * u)[numbers]
    given = np.empty((steps, 2, batch, 3 * u), np.float32)
    given[:, 0] = x[:, :, 0].transpose(1, 0, 2)
    given[:, 1] = x[:, ::-1, 1].transpose(1, 0, 2)
    if mask is not None:
        live = np.stack([mask.T, mask[:, ::-1].T], axis=1)[..., None].astype(np.float32)
    h = np.zeros((2, batch, u), np.float32)
    states = np.empty((steps, 2, batch, u), np.float32)
    kept = np.empty((steps, 4, 2, batch, u), np.float32) if trace else None
    for t in range(steps):
        own = h @ weights["state"]
        gates = _sigmoid(given[t, :, :, :2 * u] + own[:, :, :2 * u])
        z, r, inner = gates[:, :, :u], gates[:, :, u:], own[:, :, 2 * u:]
        n = np.tanh(given[t, :, :, 2 * u:] + r * inner)
        new = n + z * (h - n)
        h = new if mask is None else h + live[t] * (new - h)
        states[t] = h
        if trace:
            kept[t] = z, r, inner, n
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    scores = both @ weights["attend"]
    if mask is not None:
        scores = np.where(mask.T, scores, np.float32(-1e9))
    scores = np.exp(scores - scores.max(axis=0))
    share = scores / scores.sum(axis=0)
    pooled = (share[..., None] * both).sum(axis=0)
    logits = pooled @ weights["out"] + weights["bias"][0]
    return (logits, (states, kept, both, share, pooled, live if mask is not None else None)) if trace else logits


def gradients(weights: dict[str, np.ndarray], passed, d_logits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the recurrent part, and of the input products at (batch, positions)."""
    states, kept, both, share, pooled, live = passed
    steps, _, batch, u = states.shape
    out = {"out": pooled.T @ d_logits, "bias": np.array([d_logits.sum()], np.float32)}
    d_pooled = d_logits[:, None] * weights["out"]
    d_share = (both * d_pooled).sum(axis=2)
    d_scores = share * (d_share - (share * d_share).sum(axis=0))
    out["attend"] = (both * d_scores[..., None]).sum(axis=(0, 1))
    d_both = share[..., None] * d_pooled + d_scores[..., None] * weights["attend"]
    d_states = np.stack([d_both[:, :, :u], d_both[::-1, :, u:]], axis=1)
    d_given = np.empty((steps, 2, batch, 3 * u), np.float32)
    out["state"] = np.zeros_like(weights["state"])
    back = weights["state"].transpose(0, 2, 1)
    d_h = np.zeros((2, batch, u), np.float32)
    zero = np.zeros((2, batch, u), np.float32)
    for t in range(steps - 1, -1, -1):
        d_h = d_h + d_states[t]
        z, r, inner, n = kept[t]
        before = states[t - 1] if t else zero
        d_new = d_h if live is None else live[t] * d_h
        d_in = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (before - n) * z * (1 - z)
        d_r = d_in * inner * r * (1 - r)
        d_own = np.concatenate([d_z, d_r, d_in * r], axis=2)
        d_given[t] = np.concatenate([d_z, d_r, d_in], axis=2)
        out["state"] += before.transpose(0, 2, 1) @ d_own
        d_h = d_new * z + d_own @ back + (0 if live is None else (1 - live[t]) * d_h)
    d_x = np.stack([d_given[:, 0].transpose(1, 0, 2), d_given[:, 1].transpose(1, 0, 2)[:, ::-1]], axis=2)
    return out, d_x.reshape(batch, steps, 6 * u)


def _sums(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key, as an array of n rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        out[ordered[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def step(model: Model, features: WordFeatures, numbers: np.ndarray, mask: np.ndarray, labels: np.ndarray, weight: np.ndarray, at: int, rate: float) -> float:
    """One step of Adam on a batch; returns the loss."""
    w = model.weights
    x, product = model.inputs(features)
    logits, passed = forward(w, product, numbers, mask, trace=True)
    p = _sigmoid(logits)
    loss = float(-(weight * np.where(labels, np.log(p + 1e-7), np.log(1 - p + 1e-7))).mean())
    grads, d_x = gradients(w, passed, (weight * (p - labels) / len(labels)).astype(np.float32))
    d_product = _sums(numbers.ravel(), d_x.reshape(-1, d_x.shape[2]), len(product))
    d_product[0] = 0
    grads["in"], grads["in_bias"] = x.T @ d_product, d_product.sum(axis=0)
    d_emb = d_product @ w["in"].T
    grads["word"] = _sums(features.word, d_emb, WORD_BUCKETS)
    grads["char"] = _sums(features.chars, np.repeat(d_emb / features.counts[:, None].astype(np.float32), features.counts, axis=0), CHAR_BUCKETS)
    for name, g in grads.items():
        m, v = model._moments.setdefault(name, (np.zeros_like(w[name]), np.zeros_like(w[name])))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w[name] -= rate * (m / (1 - 0.9 ** at)) / (np.sqrt(v / (1 - 0.999 ** at)) + 1e-6)
        if name in ("word", "char"):
            w[name] -= rate * DECAY / RATE * w[name]
    return loss


def _batch(docs: list[np.ndarray], chosen: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.zeros((len(chosen), WINDOW), np.int32)
    for row, (doc, start) in enumerate(chosen):
        piece = docs[doc][start:start + WINDOW]
        numbers[row, :len(piece)] = piece
    return numbers, numbers > 0


def window_logits(model: Model, docs: list[np.ndarray], types: list[bytes]) -> list[np.ndarray]:
    """Logits of all windows of each document; documents without words have none."""
    if not docs:
        return []
    product = model.inputs(word_features(types))[1]
    places = [(d, int(s)) for d, words in enumerate(docs) if len(words) for s in windows_of(len(words))]
    full = [p for p in places if len(docs[p[0]]) >= WINDOW]
    short = [p for p in places if len(docs[p[0]]) < WINDOW]
    found: list[list[float]] = [[] for _ in docs]
    for chosen, masked in ((full, False), (short, True)):
        for i in range(0, len(chosen), SCORE_BATCH):
            part = chosen[i:i + SCORE_BATCH]
            numbers, mask = _batch(docs, part)
            for (doc, _), value in zip(part, forward(model.weights, product, numbers, mask if masked else None)):
                found[doc].append(float(value))
    return [np.array(v) for v in found]


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Calibrated score of each whole text: that of its highest window."""
    types = Types()
    docs = [types.numbers(t) for t in texts]
    top = np.array([v.max() if len(v) else np.nan for v in window_logits(model, docs, list(types))])
    scores = 1 / (1 + np.exp(-np.clip(model.slope * top + model.intercept, -60, 60)))
    return np.where(np.isnan(top), model.empty, scores) if len(top) else np.zeros(0)


def _calibrate(model: Model, top: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """Slope and intercept by weighted logistic regression (Newton's method with a small penalty)."""
    x = np.stack([top, np.ones_like(top)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (labels - p)) - 1e-2 * (beta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        change = np.linalg.solve(hessian, g)
        beta = beta + np.clip(change, -2, 2)
        if abs(change).max() < 1e-6:
            break
    model.slope, model.intercept = max(float(beta[0]), 1e-3), float(beta[1])


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 11) -> Model:
    """Windows learn from their text's label: a text with label 1 through its highest window, others through their highest and random ones.

    ``prior`` is the share of label 1 among all labelled rows, which the calibration restores.
    """
    rng, model, types = np.random.default_rng(seed), new_model(seed), Types()
    model.empty = min(prior, 0.49)
    docs = [types.numbers(t) for t in texts]
    usable = [d for d in range(len(docs)) if len(docs[d])]
    if len({bool(labels[d]) for d in usable}) < 2:
        model.slope, model.intercept = 1e-3, float(np.log(max(model.empty, 1e-3) / (1 - model.empty)))
        return model
    names, at = list(types), 0
    starts = [windows_of(len(words)) for words in docs]
    epoch = 0
    while epoch < EPOCHS or at < MIN_STEPS:
        chosen: list[tuple[int, int]] = []
        logits = window_logits(model, docs, names) if epoch else None
        for d in usable:
            n = len(starts[d])
            picked = set(rng.choice(n, min(n, 4 if epoch == 0 else 1), replace=False).tolist()) if epoch == 0 or not labels[d] else set()
            if logits is not None:
                picked |= set(np.argsort(-logits[d], kind="stable")[:1 if labels[d] else 2].tolist())
            chosen += [(d, int(starts[d][k])) for k in sorted(picked)]
        order = rng.permutation(len(chosen))
        marks = np.array([labels[d] for d, _ in chosen], dtype=np.float32)
        balance = np.where(marks > 0, len(marks) / (2 * max(1, marks.sum())), len(marks) / (2 * max(1, (1 - marks).sum()))).astype(np.float32)
        for i in range(0, len(order), TRAIN_BATCH):
            rows = order[i:i + TRAIN_BATCH]
            numbers, mask = _batch(docs, [chosen[k] for k in rows])
            used, local = np.unique(np.append(0, numbers), return_inverse=True)
            at += 1
            mask &= (rng.random(mask.shape) >= HIDDEN) | (mask.cumsum(axis=1) == 1)
            step(model, word_features([names[k] for k in used]), local[1:].reshape(numbers.shape), mask, marks[rows], balance[rows], at, RATE / (1 + 4 * min(epoch / EPOCHS, at / MIN_STEPS)))
        epoch += 1
    top = np.array([v.max() if len(v) else np.nan for v in window_logits(model, docs, names)])
    known = ~np.isnan(top)
    y = np.asarray(labels, dtype=float)[known]
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    _calibrate(model, top[known], y, weight)
    return model
