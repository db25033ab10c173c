"""Operator 2, quality classifier: random-indexing word vectors and a two-layer numpy network."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.sampling import labelled_sample

#: Labelled rows of each class that the model is fitted on.
PER_CLASS = 2500
DIMS, NONZERO, WINDOW, LEAST_COUNT, MOST_WORDS, HIDDEN = 64, 6, 2, 3, 40_000, 24
_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
#: Shapes of a token that repeats the one before, and of one that stands anywhere before in the text.
_REPEAT, _AGAIN = "<=>", "<again>"


def shape(token: str) -> str:
    """Kind of a token: case pattern of a word, digits, or the first mark and length of a run of marks."""
    if token[0].isalpha():
        case = "A" if len(token) > 1 and token.isupper() else "Aa" if token[0].isupper() else "a"
        return f"<{case}{min(len(token) // 6, 3)}>"
    if token[0].isdigit():
        return f"<0{min(len(token) // 4, 3)}>"
    return f"<{token[0]}{min(len(token), 3)}>"


def index_vector(word: str) -> np.ndarray:
    """Sparse ternary vector of a word, by its hash alone."""
    rng = np.random.default_rng(zlib.crc32(word.encode("utf-8", "replace")))
    v = np.zeros(DIMS, dtype=np.float32)
    v[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


@dataclass
class QualityModel:
    """Rows of ``vectors`` are of the words in ``rows``; a word not there has the row of its shape, if any."""

    rows: dict[str, int]
    vectors: np.ndarray
    shapes: dict[str, int]
    weights: list[np.ndarray]
    temperature: float

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean word vector and mean shape vector of a text; zeros if it has no token."""
        tokens = _TOKEN.findall(text or "")
        counts = Counter(tokens)
        out = np.zeros(2 * DIMS, dtype=np.float32)
        if not counts:
            return out
        words = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        words /= words.sum()
        kinds = [shape(t) for t in counts]
        of = [self.shapes.get(k, 0) for k in kinds]
        at = [self.rows.get(t, s) for t, s in zip(counts, of, strict=True)]
        out[:DIMS] = words @ self.vectors[at]
        out[DIMS:] = words @ self.vectors[of]
        repeats = sum(map(eq, tokens, islice(tokens, 1, None)))
        for kind, n in ((_REPEAT, repeats), (_AGAIN, len(tokens) - len(counts))):
            out[DIMS:] += self.vectors[self.shapes.get(kind, 0)] * np.float32(n / len(tokens))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        return (np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([self.pooled(t) for t in texts]) if texts else np.zeros((0, 2 * DIMS))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_vectors(texts: list[str]) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    """Context vectors by random indexing: of a word, the sum of its neighbours' index vectors, damped and scaled to length 1.

    Row 0 is zero. Shapes have rows of their own, whose context is what
    surrounds the words of that shape.
    """
    counts: Counter[str] = Counter()
    for t in texts:  # tokens are found again below: those of all texts at once would take many times the texts' memory
        counts.update(_TOKEN.findall(t))
    kept = sorted((w for w, n in counts.items() if n >= LEAST_COUNT), key=lambda w: (-counts[w], w))[:MOST_WORDS]
    rows = {w: k + 1 for k, w in enumerate(kept)}
    kind = {w: shape(w) for w in counts}
    shapes = {s: len(rows) + k + 1 for k, s in enumerate(sorted({*kind.values(), _REPEAT, _AGAIN}))}
    own = np.zeros((1 + len(rows) + len(shapes), DIMS), dtype=np.float32)
    for w, k in [*rows.items(), *shapes.items()]:
        own[k] = index_vector(w)
    place = {w: rows.get(w, shapes[kind[w]]) for w in counts}
    shape_row = {w: shapes[kind[w]] for w in counts}
    context = np.zeros_like(own)
    for ts in map(_TOKEN.findall, texts):
        if len(ts) < 2:
            continue
        at = np.fromiter((place[t] for t in ts), dtype=np.int64, count=len(ts))
        sums = np.cumsum(np.concatenate([np.zeros((1, DIMS)), own[at]]), axis=0)
        i = np.arange(len(ts))
        near = sums[np.minimum(i + WINDOW + 1, len(ts))] - sums[np.maximum(i - WINDOW, 0)] - own[at]
        for rows_of in (at, np.fromiter((shape_row[t] for t in ts), dtype=np.int64, count=len(ts))):
            order = np.argsort(rows_of, kind="stable")
            first = np.flatnonzero(np.diff(rows_of[order], prepend=-1))
            context[rows_of[order][first]] += np.add.reduceat(near[order], first, axis=0)
    context = np.sign(context) * np.log1p(np.abs(context))
    context += own  # what a word is, besides what it stands beside
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return rows, shapes, (context / np.maximum(norm, 1e-9)).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, seed: int = 7, epochs: int = 40) -> QualityModel:
    """Network by Adam on 85 % of the rows, temperature by the rest; ``weight`` of each row undoes the sample's shares."""
    rows, shapes, vectors = fit_vectors(texts)
    model = QualityModel(rows, vectors, shapes, [], 1.0)
    x = np.stack([model.pooled(t) for t in texts]).astype(np.float64)
    y, rng = labels.astype(np.float64), np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cal, train = np.split(order, [max(1, len(x) * 15 // 100)])
    train = train if len(train) else cal
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 0.02
    prior = np.clip(np.average(y[train], weights=weight[train]), 0.01, 0.99)
    p = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 0.1, (HIDDEN, 1)), np.array([np.log(prior / (1 - prior))]),
    ]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[at] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip((h @ p[2] + p[3])[:, 0], -60, 60)))
            d = ((out - y[at]) * weight[at] / weight[at].mean() / len(at))[:, None]
            dh = d @ p[2].T * (1 - h * h)
            grads = [z[at].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = [mean, scale, *p]
    out = model.logits(x[cal])

    def loss(t: float) -> float:
        q = np.clip(1 / (1 + np.exp(-np.clip(out / t, -60, 60))), 1e-9, 1 - 1e-9)
        return -np.average(y[cal] * np.log(q) + (1 - y[cal]) * np.log(1 - q), weights=weight[cal])

    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return model


def fit_quality(labels: DataFrame, docs: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Model fitted on a bounded sample of labelled rows: ``labels`` (id, label 0 or 1) and ``docs`` (id, text).

    Rows without an id or a label are left out, a null text counts as empty,
    and rows that repeat an id each count. With one label, or no labelled row
    at all, the model's score is that label's share or one half.
    """
    table, sizes = labelled_sample(labels, docs, per_class)
    texts = [t or "" for t in table["text"].to_pylist()]
    y = np.array(table["label"].to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of label 1, or one half
        share = float(y[0]) if len(y) else 0.5
        size = [np.zeros(2 * DIMS), np.ones(2 * DIMS), np.zeros((2 * DIMS, 1)), np.zeros(1), np.zeros((1, 1))]
        logit = np.array([np.log(np.clip(share, 0.02, 0.98) / (1 - np.clip(share, 0.02, 0.98)))])
        return QualityModel({}, np.zeros((1, DIMS), np.float32), {}, [*size, logit], 1.0)
    drawn = Counter(y.tolist())
    weight = np.array([sizes[k] / drawn[k] for k in y.tolist()])
    return fit(texts, y, weight)


def quality_score(text: Column, model: QualityModel, spark) -> Column:
    """Probability of label 1 of each whole text. The model is broadcast; its size is bounded.

    A null text counts as empty, and an empty one has the score of no token at
    all. Equal texts get equal scores; no rows give no rows.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            yield pd.Series(known.score(texts.tolist()), dtype="float64")

    return of(text)
