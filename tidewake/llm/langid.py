"""Operator 7, language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.sampling import labelled_sample

#: Labelled rows of each language that the model is fitted on.
PER_LANGUAGE = 1500
BUCKETS, DIMS, NGRAMS = 1 << 15, 16, (2, 3, 4)
#: Share of wrong answers that accepted predictions may have on the calibration rows.
TOLERATED = 0.005
#: Bytes of a text that are hashed at once.
_AT_ONCE = 1 << 20


def normalised(text: str) -> np.ndarray:
    """Bytes of the lower-cased text, whose white space is single blanks, at either end too."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8)


def buckets(b: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams of some bytes. Parts of ``_AT_ONCE`` overlap, so that none over a cut is lost or counted twice."""
    for at in range(0, len(b), _AT_ONCE):
        for n in NGRAMS:
            part = b[at : at + _AT_ONCE + n - 1].astype(np.uint32)
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                yield h % np.uint32(BUCKETS)


@dataclass
class LanguageModel:
    """``table``: per bucket and language, the product of embedding and softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in buckets(normalised(text)):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        z = np.array([self.logits(t or "") for t in texts]).reshape(len(texts), -1) / self.temperature
        p = _softmax(z)
        best = p.argmax(axis=1)
        return [self.languages[k] for k in best], p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 4) -> LanguageModel:
    """Stochastic gradient descent over whole texts and a random piece of each; a tenth of the rows calibrates.

    Calibration fits the temperature, then the least score at which at most
    ``TOLERATED`` of the accepted predictions are wrong.
    """
    names = sorted(set(labels))
    y = np.array([names.index(k) for k in labels])
    rng = np.random.default_rng(seed)
    emb, w, bias = rng.normal(0, 0.1, (BUCKETS, DIMS)), np.zeros((len(names), DIMS)), np.zeros(len(names))
    w += rng.normal(0, 0.1, w.shape)
    order = rng.permutation(len(texts))
    cal, train = np.split(order, [len(texts) // 10])
    rows = []
    for i in train:
        t = texts[i]
        start, size = int(rng.integers(0, max(1, len(t) - 20))), int(rng.integers(15, 200))
        for piece in (t, t[start : start + size]):
            h, n = np.unique(np.concatenate([*buckets(normalised(piece)), np.zeros(0, np.uint32)]), return_counts=True)
            if len(h):
                rows.append((h, (n / n.sum()).astype(np.float32)[:, None], y[i]))
    for epoch in range(epochs):
        rate = 0.8 * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            h, share, label = rows[k]
            part = emb[h]
            mean = (share * part).sum(axis=0)
            d = _softmax(w @ mean + bias)
            d[label] -= 1
            emb[h] = part - rate * 20 * share * (d @ w)
            w -= rate * np.outer(d, mean)
            bias -= rate * 0.1 * d
    model = LanguageModel(names, (emb @ w.T).astype(np.float32), bias, 1.0, 0.0)
    if len(cal):
        z, truth = np.array([model.logits(texts[i]) for i in cal]), y[cal]

        def loss(t: float) -> float:
            return -np.log(np.clip(_softmax(z / t)[np.arange(len(truth)), truth], 1e-9, 1)).mean()

        model.temperature = float(min(np.geomspace(0.1, 8, 80), key=loss))
        p = _softmax(z / model.temperature)
        score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
        down = np.argsort(-score, kind="stable")
        fine = np.flatnonzero(np.cumsum(wrong[down]) <= TOLERATED * np.arange(1, len(down) + 1))
        model.least = float(score[down][fine[-1]]) if len(fine) else 1.0
    return model


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Model fitted on a bounded sample of ``docs`` (id, label, text); None if no row has a label and a text.

    Rows without an id, a label or a text are left out; rows that repeat an id
    are in the sample together or not at all, each with its own label. Empty
    texts have no n-gram and only count for the calibration.
    """
    table, _ = labelled_sample(docs.where("text IS NOT NULL"), None, per_language)
    return fit(table["text"].to_pylist(), table["label"].to_pylist()) if len(table) else None


def language_of(text: Column, model: LanguageModel | None, spark) -> Column:
    """Struct (lang_pred, score, accepted) for each whole text.

    ``und``, with score 0 and not accepted, if the text is null or has no
    letter, or if nothing was learned. Else always a learned language;
    ``accepted`` says whether its score reaches the calibrated bound. Of
    languages with equal scores the first by name is taken; equal texts get
    equal answers; no rows give no rows.
    """
    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    if model is None:
        return nothing
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            lang, score = known.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score, "accepted": score >= known.least})

    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), of(text)).otherwise(nothing)
