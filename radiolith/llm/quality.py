"""Quality rules: plain counts of a text, and a logistic regression on hashed word and character n-grams.

Features are shares of a text's n-grams in four tables of 65,536 places: pairs and triples of bytes, words, and pairs of words (equal neighbours are one
pair, whatever the word).  The regression is fitted on a bounded, stratified sample of labelled rows (``PER_LABEL`` of each label, by
hash order), its log-odds are calibrated on labelled rows that the fit doesn't see, and every text is scored whole, in Arrow batches,
against fixed thresholds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release_memory

#: Most labelled rows of each label that the fit reads; one in ``CALIBRATION`` of them, by hash, calibrates.
PER_LABEL = 2048
CALIBRATION = 4
#: Least documents of the sample that a feature is in.
LEAST_DOCUMENTS = 3
#: Base rules: least words, and most words in repeated windows, in hundredths.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Least probability of good quality to keep a text, and below which it is rejected outright rather than doubtful.
KEEP = 0.5
REJECT = 0.1
PLACES = 1 << 16
FAMILIES = 4
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes whose n-grams are hashed at a time.
STRETCH = 1 << 20
STEPS = 120


def _numbers(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return ids, list(known)


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """How many words lie in windows of ``width`` words that are found twice or more; ``ids`` are numbers below their count."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, width):
        key = key * len(ids) + ids[k : k + n]
        if k < width - 1 and len(ids) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = order[np.append(same, False) | np.append(False, same)]
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[again + k] = True
    return int(covered.sum())


def base_counts(text: str, data: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated windows."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    blank = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated_words(ids)


def places_of(data: bytes, ids: np.ndarray, distinct: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Family and places of a text's n-grams, a stretch at a time."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), STRETCH):
        x = raw[at : at + STRETCH + 2].astype(np.uint32)
        pairs = (x[:-1] << np.uint32(8)) | x[1:]
        yield 0, pairs[:STRETCH]
        yield 1, (((pairs[:-1] << np.uint32(8)) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    if len(ids):
        h = np.fromiter(map(zlib.crc32, distinct), dtype=np.uint32, count=len(distinct))[ids]
        yield 2, h >> np.uint32(16)
        both = (((h[:-1] * np.uint32(0x85EBCA77)) ^ h[1:]) * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
        yield 3, np.where(h[:-1] == h[1:], np.uint32(0), np.maximum(both, np.uint32(1)))


@dataclass
class QualityModel:
    """Weights (family, place) and bias of the log-odds of good quality, and the slope and shift that calibrate them."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, data: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
        total, n = np.zeros(FAMILIES), np.zeros(FAMILIES)
        for family, places in places_of(data, ids, distinct):
            total[family] += self.weights[family][places].sum(dtype=np.float64)
            n[family] += len(places)
        return self.bias + float((total / np.maximum(n, 1)).sum())

    def probability(self, data: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
        z = self.slope * self.log_odds(data, ids, distinct) + self.shift
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


#: What stands for a model where no labels of both kinds are: everything is good.
NO_MODEL = QualityModel(np.zeros((FAMILIES, PLACES), dtype=np.float32), 20.0)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sampled rows (text, good, calibrates): their places over all families and the shares of each."""
    release_memory()
    for batch in batches:
        rows: list[tuple] = []
        for text, good, held in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode("utf-8")
            ids, distinct = _numbers(data.split())
            counts = np.zeros((FAMILIES, PLACES), dtype=np.float32)
            for family, places in places_of(data, ids, distinct):
                counts[family] += np.bincount(places, minlength=PLACES)
            counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
            at = np.flatnonzero(counts)
            rows.append((good, held, at.astype(np.int32), counts.ravel()[at]))
        good, held, at, share = zip(*rows) if rows else ((),) * 4
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in at])), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, kind), *x]))) for x, kind in ((at, np.int32), (share, np.float32))]
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(held, pa.bool_()), *lists], ["good", "held", "places", "shares"])


def fit_logistic(row: np.ndarray, place: np.ndarray, share: np.ndarray, good: np.ndarray, weight: np.ndarray, places: int, ridge: float = 1e-6, steps: int = STEPS, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Adam over all rows; ``row``, ``place`` and ``share`` are the features of the rows."""
    theta, m, v = (np.zeros(places + 1) for _ in range(3))
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, weights=theta[place] * share, minlength=len(good))
        slope = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - good)
        grad = np.append(np.bincount(place, weights=slope[row] * share, minlength=places), slope.sum())
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return theta[:-1], float(theta[-1])


def calibrate(z: np.ndarray, good: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of log-odds that make them probabilities of rows outside the fit, by Newton's method; targets are drawn in by one row of each kind."""
    top, low = weight[good > 0].sum(), weight[good == 0].sum()
    if not top or not low:
        return 1.0, 0.0
    target = np.where(good > 0, (top + 1) / (top + 2), 1 / (low + 2))
    scale = max(1e-9, float(np.abs(z).max()))
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    theta = np.array([1.0, 0.0])
    loss = lambda t: float((weight * (np.logaddexp(0.0, x @ t) - target * (x @ t))).sum() + 1e-6 * t[0] ** 2)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -500, 500)))
        grad = x.T @ (weight * (p - target)) + [2e-6 * theta[0], 0.0]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([2e-6, 1e-9])
        move, step = np.linalg.solve(hessian, grad), 1.0
        while step > 1e-6 and loss(theta - step * move) > loss(theta):
            step /= 2
        theta = theta - step * move
        if np.abs(step * move).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel:
    """Train on the labelled rows of ``docs``: ``labels`` has doc_id and quality (0 or 1; nulls are left out, a doc_id labelled both ways counts as 0).

    Reads at most ``per_label`` rows of each label, weighed so that they stand for all.  Without labels of both kinds everything is good.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    counts = {r[0]: r[1] for r in known.groupBy("good").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return NO_MODEL
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("good = 1").orderBy(*order).limit(per_label).unionByName(known.where("good = 0").orderBy(*order).limit(per_label))
    chosen = chosen.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")  # at most 2 * per_label rows of three numbers
    rows = sample.select("text", "good", "held").mapInArrow(_sample_features, "good int, held boolean, places array<int>, shares array<float>").toArrow().combine_chunks()
    discard(sample)
    good, held = (rows.column(c).to_numpy(zero_copy_only=False) if c == "held" else rows.column(c).to_numpy() for c in ("good", "held"))
    if len(np.unique(good[~held])) < 2:
        return NO_MODEL
    lists = [rows.column(c).combine_chunks() for c in ("places", "shares")]
    place, share = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    row = np.repeat(np.arange(len(good), dtype=np.int32), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    del rows, lists
    weight = np.where(good > 0, counts[1] / max(1, (good > 0).sum()), counts[0] / max(1, (good == 0).sum()))
    fits = ~held[row]
    common = np.flatnonzero(np.bincount(place[fits], minlength=FAMILIES * PLACES) >= LEAST_DOCUMENTS)
    name = np.full(FAMILIES * PLACES, -1, dtype=np.int32)
    name[common] = np.arange(len(common))
    use = fits & (name[place] >= 0)
    theta, bias = fit_logistic(row[use], name[place[use]], share[use], good.astype(float), np.where(held, 0.0, weight), len(common))
    weights = np.zeros(FAMILIES * PLACES, dtype=np.float32)
    weights[common] = theta
    z = bias + np.bincount(row, weights=weights[place] * share, minlength=len(good))
    slope, shift = calibrate(z[held], good[held], weight[held])
    return QualityModel(weights.reshape(FAMILIES, PLACES), bias, slope, shift)


_OUT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64()), ("verdict", pa.string())]


def assess(docs: DataFrame, model: QualityModel, keep: float = KEEP, reject: float = REJECT) -> DataFrame:
    """Row by row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability, verdict.

    ``verdict`` is "keep" from ``keep`` on, "reject" below ``reject``, else "doubtful"; ``kept`` asks for "keep" and passed base rules.  A null or empty text
    has no words and fails them.  Rows that repeat, a null doc_id and an empty table are as they come.  Reads doc_id and text only; no shuffle.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double, verdict string"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte of weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        model = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                data = text.encode("utf-8")
                words = data.split()
                ids, distinct = _numbers(words)
                counts = base_counts(text, data, words, ids)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                p = model.probability(data, ids, distinct)
                rows.append((*counts, failed, not failed and p >= keep, p, "keep" if p >= keep else "reject" if p < reject else "doubtful"))
            columns = list(zip(*rows)) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _OUT))], ["doc_id", *(n for n, _ in _OUT)])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
