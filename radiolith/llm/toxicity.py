"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is a bag of sentences.  A sentence's log-odds are a bias plus the weights of its words and of the
words' first letters (so that inflected forms share evidence); the document's probability is
one minus the product of the sentences' probabilities of being clean, each over that of a sentence without any
feature, and of a document's own of being called toxic for no sentence at all (a leak, so that labels without an offending word aren't laid on every
sentence).  So plain sentences add nothing, however many there are; and of what sentences add that alone would not make a document toxic, the share that
as many sentences of clean documents have, and three deviations of it, is taken off, so that stray features of a long clean text don't add up.  Which features may
carry weight is settled by a likelihood-ratio screen over the labelled training rows, the weights by gradient
descent on the noisy-or likelihood.  Both use a bounded, stratified sample of labelled rows (``PER_LABEL`` of
each label, by hash order); everything that is scored is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release_memory, remainder_of_crc32

#: Most labelled rows of each label that the fit reads, and most features that it weighs.
PER_LABEL = 8192
MOST_FEATURES = 8192
#: Least likelihood ratio (2 log) for a feature to be weighed, and least documents that have it.
SCREEN = 16.0
LEAST_DOCUMENTS = 3
#: How many times commoner in toxic rows a feature must be; what long documents merely have more of stays out.
LEAST_LIFT = 3.0
PREFIXES = (4, 5, 6)
ACCEPT = 0.7
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings marked with a trailing hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicityModel:
    """``weights`` by feature and the ``bias`` of a sentence without any.

    With a ``leak``, the least a document of any sentences takes off the logarithm of being clean, sentences count beyond
    what one without any feature has; without it their noisy-or is plain.  ``stray`` is what sentences of clean documents add that alone don't make a document
    toxic: its mean for each sentence, and that of its square.
    """

    weights: dict[str, float]
    bias: float
    leak: float | None = None
    stray: tuple[float, float] = (0.0, 0.0)

    def scorer(self) -> SentenceScorer:
        return SentenceScorer(self)


class _WordWeights(dict):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        value = sum(get(f, 0.0) for f in features_of(word))
        if len(self) > 100_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


#: What a sentence adds at least that alone makes a document toxic.
STRONG = -math.log(1.0 - ACCEPT)


class SentenceScorer:
    """Scores sentences and whole documents with a model."""

    def __init__(self, model: ToxicityModel):
        self.bias = model.bias
        self.leak = model.leak
        self.stray = model.stray
        self.word = _WordWeights(model.weights)

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of every sentence that has a word."""
        text = text or ""
        out, look = [], self.word.__getitem__
        for m in _SENTENCE.finditer(text):
            if words := _WORD.findall(m[0].lower()):
                out.append((m.start(), m.end(), self.bias + sum(map(look, set(words)))))
        return out

    def document(self, text: str | None) -> tuple[float, int, tuple[int, int, float] | None]:
        """Noisy-or of the sentences, their number, and the one likeliest to offend."""
        found = self.sentences(text)
        plain = 0.0 if self.leak is None else _softplus(self.bias)
        adds = [_softplus(z) - plain for _, _, z in found if self.leak is None or z > self.bias]
        weak = sum(x for x in adds if x < STRONG)
        if self.leak is not None:
            weak = max(0.0, weak - self.stray[0] * len(found) - 3.0 * math.sqrt(self.stray[1] * len(found)))
        clean = weak + sum(x for x in adds if x >= STRONG) + (found and self.leak or 0.0)
        return min(1.0, max(0.0, -math.expm1(-clean))), len(found), max(found, key=lambda s: s[2], default=None)


def _screened(sample: DataFrame, totals: dict[int, int]) -> list[tuple[str, float]]:
    """Features that are commoner in toxic rows by the likelihood ratio, strongest first, with that ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush():
            keys = list(set(seen[0]) | set(seen[1]))
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["feature", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                seen[label].update({f for w in words for f in features_of(w)})
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    counts = sample.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pos, neg = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))
    a, b = F.col("toxic"), F.col("clean")
    p = (a + b) / F.lit(float(pos + neg))
    term = lambda k, n: F.when(k > 0, k * F.log(k / F.lit(float(n)) / p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((1 - k / F.lit(float(n))) / (1 - p))).otherwise(0.0)
    kept = counts.where((a + b >= LEAST_DOCUMENTS) & (a / pos > LEAST_LIFT * b / neg)).withColumn("ratio", 2 * (term(a, pos) + term(b, neg)))
    rows = kept.where(F.col("ratio") >= SCREEN).orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES).select("feature", "ratio").collect()
    return [(r[0], r[1]) for r in rows]


def _bags(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sampled rows: label; of the features of their sentences that have one:
    row, sentence and feature numbers (``row`` by sentence); and how many sentences each row has.  Comes as Arrow columns, a few bytes for each feature found."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, counts, features, every = [], [], [], []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                sizes, ids, n = [], [], 0
                for m in _SENTENCE.finditer((text.as_py() or "").lower()):
                    if words := _WORD.findall(m[0]):
                        n += 1
                        if own := [index[f] for w in set(words) for f in features_of(w) if f in index]:
                            sizes.append(len(own))
                            ids += own
                labels.append(label)
                counts.append(sizes)
                features.append(ids)
                every.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(counts, pa.list_(pa.int32())), pa.array(features, pa.list_(pa.int32())), pa.array(every, pa.int32())], ["toxic", "sizes", "ids", "sentences"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, sizes array<int>, ids array<int>, sentences int").toArrow().combine_chunks()
    lists = [rows.column(c).combine_chunks() for c in ("sizes", "ids")]
    sizes, ids = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    row = np.repeat(np.arange(len(rows)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    return rows.column("toxic").to_numpy(), row, np.repeat(np.arange(len(sizes)), sizes), ids, rows.column("sentences").to_numpy()


def _stray(bags, weights: np.ndarray, bias: float) -> tuple[float, float]:
    """Mean, and mean square, of what a sentence of the clean rows adds where it alone wouldn't make its document toxic."""
    labels, row, owner, feature, sentences = bags
    z = bias + np.bincount(owner, weights=weights[feature], minlength=len(row))
    adds = (np.logaddexp(0.0, z) - np.logaddexp(0.0, bias))[labels[row] == 0]
    weak, n = adds[adds < STRONG], max(1, int(sentences[labels == 0].sum()))
    return float(weak.sum() / n), float((weak * weak).sum() / n)


def _fit_weights(bags, n_features: int, class_weight: dict[int, float], steps: int = 600, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by Adam on the noisy-or likelihood of the bags."""
    labels, row, owner, feature = bags[:4]
    weight = np.where(labels > 0, class_weight[1], class_weight[0])
    weight = weight / weight.sum()
    theta = np.zeros(n_features + 2)
    theta[-2:] = -6.0, -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b, leak = theta[:-2], theta[-2], math.exp(theta[-1])
        z = b + np.bincount(owner, weights=w[feature], minlength=len(row))
        total = np.maximum(leak + np.bincount(row, weights=np.logaddexp(0.0, z) - np.logaddexp(0.0, b), minlength=len(labels)), 1e-12)
        slope = weight * np.where(labels > 0, -1.0 / np.expm1(np.minimum(total, 700.0)), 1.0)
        dz = slope[row] / (1.0 + np.exp(-z))
        db = dz.sum() - slope[row].sum() / (1.0 + math.exp(-b))
        grad = np.concatenate((np.bincount(feature, weights=dz[owner], minlength=n_features) + ridge * w, [db, slope.sum() * leak]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        theta[:-2] = np.maximum(theta[:-2], 0.0)
        theta[-2] = min(theta[-2], -2.0)
        theta[-1] = min(theta[-1], math.log(math.log(2.0)))  # the leak alone calls nothing toxic
    return theta[:-2], float(theta[-2]), math.exp(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, train, per_label: int = PER_LABEL) -> ToxicityModel:
    """Train on the labelled rows of ``docs`` for which the column ``train`` holds.

    ``labels`` has doc_id and toxic (0 or 1; null rows are left out, a doc_id labelled both ways counts as toxic).
    Without any row of either label the model has no weights and calls nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.where(train(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel({}, -20.0)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_label).unionByName(known.where("toxic = 0").orderBy(*order).limit(per_label))
    sample = materialize(docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "sample")  # at most 2 * per_label rows of two numbers
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    names = [f for f, _ in _screened(sample, totals)]
    bags = _bags(sample, names) if names and len(totals) == 2 else None
    discard(sample)
    if bags is None:
        return ToxicityModel({}, -20.0)
    weights, bias, leak = _fit_weights(bags, len(names), {y: counts[y] / totals[y] for y in (0, 1)})
    return ToxicityModel({f: float(w) for f, w in zip(names, weights) if w > 1e-3}, bias, leak, _stray(bags, weights, bias))


def score(docs: DataFrame, model: ToxicityModel, accept: float = ACCEPT) -> DataFrame:
    """``docs`` row by row: doc_id, score, predicted, sentences, and the place and score of the worst sentence.

    Null and empty texts have no sentence and score 0, and so does every row of a model without weights.  Texts of any length are scored whole.  Rows that repeat are
    scored each, a null doc_id stays null, an empty table gives an empty result.  Reads doc_id and text only; no shuffle.
    """
    schema = "doc_id long, score double, predicted int, n_sentences int, worst_start int, worst_end int, worst_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                p, n, worst = scorer.document(text.as_py())
                rows.append((p, int(p >= accept), n, worst and worst[0], worst and worst[1], worst and 1.0 / (1.0 + math.exp(-worst[2]))))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """Place, text and score of every sentence whose own score is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, floor = model.scorer(), math.log(least / (1.0 - least))
        for batch in batches:
            rows = [(i, a, b, t[a:b], 1.0 / (1.0 + math.exp(-z))) for i, x in zip(batch.column(0).to_pylist(), batch.column(1)) if (t := x.as_py()) for a, b, z in scorer.sentences(t) if z >= floor]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start int, end int, sentence string, score double")


def in_training_folds(doc_id):
    """Rows whose crc32(doc_id as text) mod 3 is not 1."""
    return remainder_of_crc32(doc_id, 3) != 1


def without_toxic(docs: DataFrame, model: ToxicityModel, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``accept``; all columns stay. No shuffle.

    Null and empty texts stay, rows that repeat are judged each, texts of any length whole; doc_id isn't read."""

    @F.pandas_udf("double")
    def noisy_or(texts):
        scorer = model.scorer()
        return texts.map(lambda t: scorer.document(t)[0], na_action=None)

    return docs.where(noisy_or(F.coalesce(F.col("text"), F.lit(""))) < accept)
