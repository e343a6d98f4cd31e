"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in hashed features of its words, and 0
where none of them tells anything, so that length alone makes no document suspect; the document's is their
noisy-or, 1 - prod(1 - p). Only document labels are needed: the likelihood of the noisy-or
is maximised directly, and the sentences that carry a toxic document's score are then the offending ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import column, map_rows, materialise
from skarn.llm.training import held_out, train_ids

#: Labelled documents of each class that a model is fitted on, at most (bounded, documented sample).
TRAIN_POSITIVE, TRAIN_NEGATIVE = 1_500, 3_000
BITS = 18
EPOCHS = 300
CHI_SQUARE = 12.0
#: A sentence of at least this probability is offending.
OFFENDING = 0.5
MEMO_WORDS = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def word_features(token: str) -> list[int]:
    """Hashed features of a white-space token: the trimmed lower-case word and its beginnings (4 to 6)."""
    word = _TRIM.sub("", token.lower())
    if not word:
        return []
    parts = [f"w:{word}", *(f"p:{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


class NoisyOr:
    """The model: ``weights`` by feature and ``bias``; scores documents with a bounded memo of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[str, float] = {}

    def _word(self, token: str) -> float:
        value = float(self.weights[word_features(token)].sum())
        if len(self.memo) < MEMO_WORDS and len(token) <= 40:
            self.memo[token] = value
        return value

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans and logits of a text's sentences that hold a telling word."""
        spans, logits, get = [], [], self.memo.get
        for m in _SENTENCE.finditer(text):
            tokens = list(dict.fromkeys(m[0].split()))  # a repeated word tells nothing new
            if tokens:
                found = list(map(get, tokens))
                if None in found:
                    found = [self._word(t) if f is None else f for t, f in zip(tokens, found, strict=True)]
                if any(found):
                    spans.append(m.span())
                    logits.append(sum(found))
        return spans, np.array(logits, float) + self.bias

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(document's probability, offending sentences as start, end, probability)."""
        spans, z = self.sentences(text or "")
        if not spans:
            return 0.0, []
        total = 1.0 - float(np.exp(-np.logaddexp(0.0, z).sum()))
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        return min(1.0, max(0.0, total)), [(*spans[k], float(p[k])) for k in np.flatnonzero(p >= OFFENDING)]


def sentence_features(text: str, memo: dict[str, list[int]]) -> list[np.ndarray]:
    """Features of each sentence that has words; a repeated word counts once in it."""
    found = []
    for m in _SENTENCE.finditer(text):
        own: list[int] = []
        for t in dict.fromkeys(m[0].split()):
            if (f := memo.get(t)) is None:
                f = word_features(t)
                if len(memo) < MEMO_WORDS and len(t) <= 40:
                    memo[t] = f
            own += f
        if own:
            found.append(np.array(own, np.int32))
    return found


class Counts:
    """In how many documents, and in how many positive ones, each feature occurs; and how many documents have words."""

    def __init__(self) -> None:
        self.one, self.both = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        self.positive = self.documents = 0

    def add(self, label: int, sentences: list[np.ndarray]) -> None:
        if sentences:
            own = np.unique(np.concatenate(sentences))
            self.both[own] += 1
            self.documents += 1
            if label:
                self.one[own] += 1
                self.positive += 1

    def telling(self) -> np.ndarray:
        """Which features occur in positive documents clearly more often than in negative ones (chi-square over
        CHI_SQUARE): the only evidence that a noisy-or can use, its sentences being able to add suspicion alone."""
        share = self.positive / max(1, self.documents)
        expected = self.both * share
        spread = np.maximum(expected * (1 - share) * (1 - self.both / max(1, self.documents)), 1e-9)
        return (self.one > expected) & ((self.one - expected) ** 2 / spread > CHI_SQUARE)


def bag(sentences: list[np.ndarray], telling: np.ndarray) -> list[list[int]]:
    """The telling features of the sentences that have any."""
    found = (s[telling[s]] for s in sentences)
    return [s.tolist() for s in found if len(s)]


def likelihood(w: np.ndarray, y: np.ndarray, doc: np.ndarray, row: np.ndarray, x: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The noisy-or's mean negative log-likelihood, with decay, and its gradient. ``w`` ends in the bias; sentence i is
    document ``doc[i]``'s, and feature ``x[k]`` is in sentence ``row[k]``. A document's probability is 1 - prod(1 - p)
    over its sentences' p; that of none is 0, which is held at 1e-6."""
    z = np.clip(np.bincount(row, weights=w[x], minlength=len(doc)) + w[-1], -40, 40)
    clear = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(y))  # -log(1 - P)
    bounded = np.clip(clear, 1e-6, 50.0)
    loss = np.where(y == 1, -np.log(-np.expm1(-bounded)), clear).mean() + decay / 2 * (w[:-1] ** 2).sum()
    factor = np.where(y == 1, -1.0 / np.expm1(bounded), 1.0)
    slope = factor[doc] / (1.0 + np.exp(-z))
    g = np.r_[np.bincount(x, weights=slope[row], minlength=len(w) - 1), slope.sum()] / len(y)
    g[:-1] += decay * w[:-1]
    return float(loss), g


def descend(labels: list[int], bags: list[list[list[int]]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-4) -> NoisyOr:
    """Fits on documents' labels and bags by full-batch Adam on the likelihood. Where a class is missing every score is
    near 0."""
    weights = np.zeros(1 << BITS)
    if len(set(labels)) < 2:
        return NoisyOr(weights, -20.0)
    y = np.array(labels, float)
    sizes = [len(s) for b in bags for s in b]
    doc = np.repeat(np.arange(len(y)), [len(b) for b in bags])
    row = np.repeat(np.arange(len(sizes)), sizes)
    names, x = np.unique(np.array([f for b in bags for s in b for f in s], np.int64), return_inverse=True)
    w = np.r_[np.zeros(len(names)), -3.0]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        g = likelihood(w, y, doc, row, x, decay)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[names] = w[:-1]
    return NoisyOr(weights.astype(np.float32), float(w[-1]))


def fit(documents: Iterable[tuple[int, str]]) -> NoisyOr:
    """Fits on (label, text) pairs in memory; ``train`` does the same from tables."""
    memo: dict[str, list[int]] = {}
    found = [(label, sentence_features(text, memo)) for label, text in documents]
    counts = Counts()
    for label, sentences in found:
        counts.add(label, sentences)
    telling = counts.telling()
    found = [(label, bag(s, telling)) for label, s in found if s]
    return descend([label for label, _ in found], [b for _, b in found])


def train(docs: DataFrame, labels: DataFrame, positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE) -> NoisyOr:
    """Fits on bounded samples of the labelled rows outside the held-out fold; other labels are never read. Executors
    count features and take the texts apart: the driver gathers 2^BITS counts at most, and the sampled documents' telling
    features."""
    spark = docs.sparkSession
    ids = [train_ids(labels, "toxic", value, bound).withColumn("label", F.lit(value)) for value, bound in ((1, positive), (0, negative))]
    ids = materialise(ids[0].union(ids[1]), "toxicity-sample")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")

    def make_counts():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            counts, memo = Counts(), {}
            for _, label, text in items:
                counts.add(label, sentence_features(text, memo))
            yield -1, counts.positive, counts.documents
            for f in np.flatnonzero(counts.both):
                yield int(f), int(counts.one[f]), int(counts.both[f])

        return run

    parts = map_rows(rows, make_counts, [(n, pa.int64(), "bigint") for n in ("feature", "one", "both")])
    counts = Counts()
    for r in parts.groupBy("feature").agg(F.sum("one").alias("one"), F.sum("both").alias("both")).collect():
        if r.feature < 0:
            counts.positive, counts.documents = r.one, r.both
        else:
            counts.one[r.feature], counts.both[r.feature] = r.one, r.both
    telling = spark.sparkContext.broadcast(np.packbits(counts.telling()))

    def make_bags():
        own, memo = np.unpackbits(telling.value).astype(bool), {}

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, label, text in items:
                if sentences := sentence_features(text, memo):
                    yield doc_id, label, bag(sentences, own)

        return run

    kept = (pa.list_(pa.list_(pa.int32())), "array<array<int>>")
    bags = map_rows(rows, make_bags, [("doc_id", pa.int64(), "bigint"), ("label", pa.int32(), "int"), ("bag", *kept)])
    # repeated ids may repeat rows; no more are taken than the bounds say
    found = bags.orderBy("doc_id", "label", F.xxhash64("bag")).limit(positive + negative).collect()
    return descend([r.label for r in found], [r.bag for r in found])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``held_out``, ``score``, ``predicted`` (score >= 0.5) and ``sentences`` (offending
    ones: start and end in code points, probability).

    ``labels`` has ``doc_id`` and ``toxic``; null labels and ids are not learned from. A null, empty or wordless
    text scores 0. A null id is carried and not held out; repeated rows give repeated results. Only id and text
    are read. An empty table gives an empty result. Training documents are a bounded sample, read twice; the model
    (1 MB) is broadcast, and scoring is one scan without shuffle.
    """
    own = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text"))
    model = train(own, labels)
    weights = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        scorer = NoisyOr(*weights.value)

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, out, text in items:
                score, found = scorer.score(text)
                yield doc_id, out, score, int(score >= 0.5), [{"start": a, "end": b, "probability": p} for a, b, p in found]

        return run

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    fields = [
        (id_col, pa.int64(), "bigint"),
        ("held_out", pa.bool_(), "boolean"),
        ("score", pa.float64(), "double"),
        ("predicted", pa.int32(), "int"),
        ("sentences", spans, "array<struct<start:bigint,end:bigint,probability:double>>"),
    ]
    return map_rows(own.select("doc_id", held_out(F.col("doc_id")), "text"), make, fields)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).withColumn("sentences", F.size("sentences"))
