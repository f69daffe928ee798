"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words (1 and 2) and word shapes (1 to 3); a shape is the kinds of a word's
first and last characters and whether it repeats the word before. Each indicator is scaled by the log-ratio of its
smoothed counts in the two classes, and a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent. Margins of texts that a model has not seen, by cross-validation, set the logistic curve from margin
to score.

The model is fitted on at most `sample` distinct labelled texts, chosen by their hash; documents are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import _IS_WORD, _LANES, filter_batches, map_batches, materialise, mix64, slices, text_buffer, word_hashes

BITS = 20
SAMPLE = 5000
THRESHOLD = 0.3

_KIND = np.arange(256, dtype=np.uint64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4


def _shapes(raw: np.ndarray, off: np.ndarray, words: np.ndarray) -> np.ndarray:
    is_word = _IS_WORD[raw]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    begins[first], ends[last] = is_word[first], is_word[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    kind = _KIND[raw]
    again = np.zeros(len(a), np.uint64)
    again[1:] = words[1:] == words[:-1]
    return mix64(kind[a] | kind[np.minimum(a + 1, b)] << np.uint64(8) | kind[np.maximum(b - 1, a)] << np.uint64(16) | kind[b] << np.uint64(24) | again << np.uint64(32))


def features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed features of all texts in order, and the texts' offsets in them."""
    words, wo = word_hashes(raw, off)
    if not len(words):
        return
    for salt, units, widths in ((11, words, (1, 2)), (13, _shapes(raw, off, words), (1, 2, 3))):
        for n in widths:
            if len(units) < n:
                continue
            grams = np.full(len(units) - n + 1, salt * 8 + n, np.uint64)
            for j in range(n):
                grams += units[j : len(units) - n + 1 + j] * _LANES[j]
            idx = (mix64(grams) >> np.uint64(64 - BITS)).astype(np.int32)
            counts = np.maximum(np.diff(wo) - (n - 1), 0)
            if n > 1:  # n-grams that cross from one text into the next go
                keep = np.ones(len(idx), bool)
                for j in range(1, n):
                    cross = wo[1:-1] - j
                    keep[cross[(cross >= 0) & (cross < len(idx))]] = False
                # a text of fewer than n words has no n-gram at all
                idx = idx[keep]
                text_of = np.searchsorted(wo, np.flatnonzero(keep), side="right") - 1
                counts = np.bincount(text_of, minlength=len(off) - 1)
            yield idx, np.r_[0, np.cumsum(counts)]


def feature_sets(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    parts = list(features(raw, off))
    if not parts:
        return [np.empty(0, np.int32) for _ in range(len(off) - 1)]
    return [np.unique(np.concatenate([f[o[i] : o[i + 1]] for f, o in parts])) for i in range(len(off) - 1)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, by feature; the class log-ratio is multiplied in
    bias: float
    slope: float
    intercept: float

    def margins(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's distinct features."""
        n = len(off) - 1
        out = np.full(n, self.bias)
        parts = list(features(raw, off))
        if not parts:
            return out
        idx = np.concatenate([f for f, _ in parts])
        text = np.concatenate([np.repeat(np.arange(n, dtype=np.int64), np.diff(o)) for _, o in parts])
        # Of each feature's occurrences in a text, one stays: that which wrote last to the feature's slot.
        order = np.argsort(text, kind="stable")
        idx, text = idx[order], text[order]
        ends = np.searchsorted(text, np.arange(n + 1))
        slot = np.zeros(1 << BITS, np.int32)
        for i in range(n):
            own = idx[ends[i] : ends[i + 1]]
            at = np.arange(len(own), dtype=np.int32)
            slot[own] = at
            out[i] += float(self.weights[own[slot[own] == at]].sum(dtype=np.float64))
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -60, 60)))


def log_ratios(sets: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, smooth) for _ in range(2)]
    for s, y in zip(sets, labels, strict=True):
        counts[int(y)][s] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def dual_coordinate_descent(sets: list[np.ndarray], values: np.ndarray, labels: np.ndarray, cost: np.ndarray, epochs: int = 20, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM over indicator features with the given values: weights and bias."""
    w, bias = np.zeros(len(values), np.float64), 0.0
    sign = np.where(labels > 0, 1.0, -1.0)
    alpha = np.zeros(len(sets))
    xs = [values[s].astype(np.float64) for s in sets]
    norm = np.array([float(x @ x) + 1.0 for x in xs])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(sets)):
            s, x = sets[i], xs[i]
            gradient = sign[i] * (float(w[s] @ x) + bias) - 1
            projected = min(gradient, 0) if alpha[i] == 0 else max(gradient, 0) if alpha[i] == cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                w[s] += step * x
                bias += step
        if worst < tolerance:
            break
    return w, bias


def _train(sets: list[np.ndarray], labels: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    ratios = log_ratios(sets, labels)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    mean_norm = float(np.mean([float(ratios[s] @ ratios[s]) for s in sets[:500]])) or 1.0
    w, bias = dual_coordinate_descent(sets, ratios, labels, c * weight * 50 / mean_norm)
    return (w * ratios).astype(np.float32), bias


def fit(sets: list[np.ndarray], labels: np.ndarray, c: float = 0.05, folds: int = 5) -> Model:
    """Fits on all; margins of folds that a model has not seen set the logistic curve. One class alone, or fewer than
    two texts of a class, gives a constant score."""
    n = len(sets)
    share = (float(labels.sum()) + 0.5) / (n + 1)
    if n < 10 or labels.sum() < 2 or (1 - labels).sum() < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, math.log(share / (1 - share)))
    # Folds by turns within each class, so that each has its share of the rare one.
    part = np.zeros(n, np.int64)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        part[own] = np.arange(len(own)) % folds
    margins = np.zeros(n)
    for f in range(folds):
        seen, held = np.flatnonzero(part != f), np.flatnonzero(part == f)
        w, bias = _train([sets[i] for i in seen], labels[seen], c)
        margins[held] = [float(w[sets[i]].sum(dtype=np.float64)) + bias for i in held]
    slope, intercept = _logistic(margins, labels)
    w, bias = _train(sets, labels, c)
    return Model(w, bias, slope, intercept)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve with his smoothed targets, by Newton steps with a small ridge."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = float(np.std(x)) or 1.0
    z, theta = x / scale, np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * z + theta[1], -60, 60)))
        gradient = np.array([((p - target) * z).sum(), (p - target).sum()]) + 1e-3 * theta
        s = p * (1 - p)
        hessian = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 0.0) / scale, float(theta[1])


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", folds: int = 5) -> Model:
    """Learns from labelled rows whose fold is not 0. Equal texts count once; a text with both labels teaches nothing."""
    marks = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label")).where("label in (0, 1)").where(fold(F.col("id"), folds) != 0)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    # Only ids and hashes meet the labels; texts are read again for the sample alone.
    keyed = texts.select("id", F.xxhash64("text").alias("hash")).join(marks, "id")
    one = materialise(keyed.groupBy("hash").agg(F.min("id").alias("id"), F.min("label").alias("label"), F.max("label").alias("other")).where("label = other"), "labelled")
    n = one.count()
    # The hash is uniform: its lowest share has about `sample` texts; the cut below makes it exact.
    limit = min(2**63 - 1, -(2**63) + int(1.1 * sample / max(n, 1) * 2**64))
    drawn = one.where(F.col("hash") <= F.lit(limit)).select("id", "hash", F.col("label").cast("int").alias("label"))
    # At most about 1.1 * sample rows, a parameter.
    chosen = texts.join(F.broadcast(drawn), "id").where(F.xxhash64("text") == F.col("hash"))

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(1))
        for i, j in slices(off):
            found = feature_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array([x.tobytes() for x in found], pa.binary())], names=["hash", "label", "features"])

    found = {r["hash"]: r for r in map_batches(chosen.select("hash", "text", "label"), extract, "hash long, label int, features binary").collect()}
    rows = [found[h] for h in sorted(found)][:sample]
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["label"] for r in rows], dtype=np.int64))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score of each document. A null or empty text has no features and gets the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(1))
        for i, j in slices(off):
            margins = shared.value.margins(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(shared.value.scores(margins))], names=["id", "score"])

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return map_batches(source, run, "id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """Rows of docs whose score reaches the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: pa.Array) -> np.ndarray:
        raw, off = text_buffer(texts)
        return np.concatenate([shared.value.scores(shared.value.margins(raw[off[i] : off[j]], off[i : j + 1] - off[i])) >= threshold for i, j in slices(off)])

    return filter_batches(docs, text_column, good)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    scored = score(docs, learn(docs, labels, sample))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
