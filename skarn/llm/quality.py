"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from. The positives' share among the unlabelled is
estimated first: a plain positive-against-unlabelled classifier orders held-back samples, and the smallest ratio
of the unlabelled's to the positives' share above a score bounds the prior. The classifier then minimises the
non-negative unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import arrow_fields, carried, column, free_name, map_rows
from skarn.llm.training import features_of, held_out, sample_ids, train_ids

#: Trusted positives and unlabelled documents that a model is fitted on, at most (bounded, documented samples).
TRAIN_POSITIVE, TRAIN_UNLABELLED = 6_000, 8_000
THRESHOLD = 0.3
#: Confidence that the prior's ratio allows for.
DELTA = 0.1
MEMO_TOKENS = 150_000

_CASES = ("lower", "title", "upper", "mixed", "none")
_ENDS = ("letter", "comma", "stop", "digit", "other", "several")
SHAPES = len(_CASES) * len(_ENDS)
FEATURES = SHAPES + 8


def shape(token: str) -> int:
    """A token's class: case of its letters, and how it ends."""
    letters = [c for c in token if c.isalpha()]
    if not letters:
        case = 4
    elif all(c.islower() for c in letters):
        case = 0
    elif len(letters) > 1 and not any(c.islower() for c in letters):
        case = 2
    elif letters[0].isupper() and not any(c.isupper() for c in letters[1:]):
        case = 1
    else:
        case = 3
    tail = len(token) - len(token.rstrip("".join({c for c in token if not c.isalnum()}))) if not token[-1].isalnum() else 0
    if tail == 0:
        end = 3 if token[-1].isdigit() else 0
    elif tail > 1:
        end = 5
    else:
        end = 1 if token[-1] in ",;:" else 2 if token[-1] in ".!?" else 4
    return case * len(_ENDS) + end


class Features:
    """Dense features of texts; a bounded memo of tokens' classes."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def _shape(self, token: str) -> int:
        k = shape(token)
        if len(self.memo) < MEMO_TOKENS and len(token) <= 40:
            self.memo[token] = k
        return k

    def of(self, text: str | None) -> np.ndarray:
        text = text or ""
        out = np.zeros(FEATURES)
        tokens = text.split()
        n = len(tokens)
        if n:
            found = list(map(self.memo.get, tokens))
            if None in found:
                found = [self._shape(t) if k is None else k for t, k in zip(tokens, found, strict=True)]
            out[:SHAPES] = np.sqrt(np.bincount(found, minlength=SHAPES) / n)
            distinct = len(set(tokens))
            out[SHAPES] = sum(map(eq, tokens, tokens[1:])) / n
            out[SHAPES + 1] = distinct / n
            out[SHAPES + 2] = math.log(distinct) / math.log(n) if n > 1 else 1.0
            out[SHAPES + 3] = min(2.0, len(text) / n / 10)
        out[SHAPES + 4] = math.log1p(n) / 10
        out[SHAPES + 5] = float(n < 20)
        out[SHAPES + 6] = text.count("\n") / (n + 1)
        out[SHAPES + 7] = 1.0
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, w: np.ndarray, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = DELTA) -> float:
    """Share of positives among the unlabelled, from scores of rows that the ordering was not fitted on: over
    score levels, the least of (share of unlabelled above + slack) / share of positives above."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    levels = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), levels, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), levels, side="left") / len(unlabelled)
    slack = math.sqrt(math.log(4 / delta) / 2 / len(unlabelled)) + math.sqrt(math.log(4 / delta) / 2 / len(positive))
    bound = above_u / above_p + slack / above_p
    k = int(np.argmin(bound))
    return float(np.clip(above_u[k] / above_p[k], 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None = None, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights over FEATURES, prior) from the positives' and the unlabelled's features. Without positives every
    score is near 0, without unlabelled rows near the prior's."""
    weights = np.zeros(FEATURES)
    if not len(p) or not len(u):
        weights[-1] = -6.0 if not len(p) else 6.0
        return weights, 0.5
    if prior is None:
        scores = []
        for fold in (0, 1):  # each half is ordered by the other's classifier
            a, b = p[fold::2] if len(p) > 1 else p, u[fold::2] if len(u) > 1 else u

            def against(w, a=a, b=b):
                return -(a.T @ (1 - _sigmoid(a @ w))) / len(a) + (b.T @ _sigmoid(b @ w)) / len(b) + decay * w

            w = _descend(against, np.zeros(FEATURES), 300)
            scores.append(estimate_prior(p[1 - fold :: 2] @ w, u[1 - fold :: 2] @ w))
        prior = float(np.mean(scores))

    return _descend(lambda w: risk(w, p, u, prior, decay)[1], weights), prior


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """(non-negative unbiased risk under the logistic loss, the step's gradient, with decay)."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    plus = -(p.T @ (1 - sp)) / len(p)
    minus = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
    above = prior * np.logaddexp(0, -(p @ w)).mean()
    below = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    if below < 0:  # the negative part has been fitted below zero: only undo it
        return above, -minus + decay * w
    return above + below, prior * plus + minus + decay * w


def _matrix(features: DataFrame) -> np.ndarray:
    return np.array([r.x for r in features.collect()], float).reshape(-1, FEATURES)


def _features(docs: DataFrame) -> DataFrame:
    def make():
        own = Features()

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in items:
                yield doc_id, own.of(text).tolist()

        return run

    return map_rows(docs, make, [("doc_id", pa.int64(), "bigint"), ("x", pa.list_(pa.float64()), "array<double>")])


def train(docs: DataFrame, labels: DataFrame, positive: int = TRAIN_POSITIVE, unlabelled: int = TRAIN_UNLABELLED) -> tuple[np.ndarray, float]:
    """(weights, prior). Positives are labelled rows of quality 1 outside the held-out fold; the unlabelled are
    documents drawn whatever their label. Negative labels are not read."""
    p = _matrix(features_of(docs, train_ids(labels, "quality", 1, positive), positive, _features))
    u = _matrix(features_of(docs, sample_ids(docs.select("doc_id"), unlabelled), unlabelled, _features))
    return fit(p, u)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """One row a document: ``doc_id``, ``held_out``, ``score``, ``predicted`` (score >= threshold); with ``carry``
    all columns of ``docs`` and those three (columns of these names give way to them).

    ``labels`` has ``doc_id`` and ``quality``; null labels and ids are not learned from. A null or empty text is
    scored like a text without tokens. Ids are whole numbers, or text that holds them. A null id is carried and not held out; repeated rows give repeated
    results. Only id and text enter a score. An empty table gives an empty result. Training uses bounded
    samples; scoring is one scan without shuffle.
    """
    own = docs.select(column("doc_id").cast("bigint").alias("doc_id"), column("text").alias("text"))
    weights, _ = train(own, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    new = ("held_out", "score", "predicted")
    kept = carried(docs, *new) if carry else ["doc_id"]
    body, fold = free_name(docs, "quality_text"), free_name(docs, "quality_fold")
    source = docs.select(*[column(c) for c in kept], held_out(column("doc_id")).alias(fold), column("text").alias(body))

    def make():
        w, features = shared.value, Features()

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for *row, out, text in items:
                score = float(_sigmoid(features.of(text) @ w))
                yield (*row, out, score, int(score >= threshold))

        return run

    fields = arrow_fields(source, kept)
    fields += [("held_out", pa.bool_(), "boolean"), ("score", pa.float64(), "double"), ("predicted", pa.int32(), "int")]
    return map_rows(source, make, fields)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels)
