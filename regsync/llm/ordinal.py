"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .features import Sparse, fit_sample, sample_ids, score_texts

#: Places of the hashed features, first letters or digits of a word (without signs around them) that make a feature, labelled documents learned from at most.
SIZE, PREFIX, SAMPLE = 1 << 20, 7, 12_000
#: A feature is learned from if it occurs in LEAST toxic documents or more, and LIFT standard deviations more often than chance would have it.
LEAST, LIFT = 3, 3.5
#: Severity grades: 0 for documents not labelled toxic, the others by how surely a model of other documents calls a toxic one toxic.
GRADES = 4


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def weigh(count):
    """A feature's value: how often it occurs, damped; long documents aren't diluted, so one insult in a long text counts."""
    return (1 + np.log(count)).astype(np.float32)


class OrdinalRegression:
    """P(grade > k) = sigmoid(<w, x> - threshold_k): one weight vector, ordered thresholds."""

    def __init__(self, size: int = SIZE, grades: int = GRADES):
        self.size = size
        self.places, self.weights = np.zeros(0, np.int64), np.zeros(0)
        self.thresholds = np.arange(1, grades, dtype=np.float64)

    def fit(self, doc, index, value, grade, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4):
        """Adam on the likelihood of the grades, over the features that pass the screening."""
        n, k = len(grade), len(self.thresholds)
        if not n:
            return self
        share = (grade > 0).mean()
        yes, all_ = np.bincount(index[grade[doc] > 0], minlength=self.size), np.bincount(index, minlength=self.size)
        passed = (yes >= LEAST) & (yes - share * all_ >= LIFT * np.sqrt(share * (1 - share) * all_))
        own = passed[index]
        doc, value = doc[own], value[own].astype(float)
        places, at = np.unique(index[own], return_inverse=True)
        m = len(places)
        up = np.clip([(grade > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
        x = np.concatenate([np.zeros(m), np.maximum.accumulate(np.log((1 - up) / up) + 1e-3 * np.arange(k))])
        first, second, every = np.zeros(m + k), np.zeros(m + k), np.arange(n)
        for t in range(1, rounds + 1):
            w, b = x[:m], x[m:]
            s = np.bincount(doc, w[at] * value, n)
            top = np.column_stack([np.ones(n), *[_sigmoid(s - b[j]) for j in range(k)], np.zeros(n)])  # P(grade >= j)
            p = np.maximum(top[every, grade] - top[every, grade + 1], 1e-9)
            slope = top * (1 - top)
            upper, lower = slope[every, grade], slope[every, grade + 1]
            ds = -(upper - lower) / p / n
            db = [((grade == j + 1) * upper / p - (grade == j) * lower / p).sum() / n for j in range(k)]
            grad = np.concatenate([np.bincount(at, ds[doc] * value, m) + decay * w, db])
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            x = x - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            x[:m] = np.maximum(x[:m], 0)  # what passed tells for toxicity, never against it
            x[m:] = np.maximum.accumulate(x[m:])
        self.places, self.weights, self.thresholds = places, x[:m], x[m:]
        return self

    def _weight(self, index):
        if not len(self.places):
            return np.zeros(len(index))
        at = np.minimum(np.searchsorted(self.places, index), len(self.places) - 1)
        return np.where(self.places[at] == index, self.weights[at], 0.0)

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        s = Sparse(texts, self.size, PREFIX)
        x = weigh(s.count)
        line = np.bincount(s.doc, self._weight(s.index) * x, s.n) if len(s.doc) else np.zeros(s.n)
        return _sigmoid(line[:, None] - self.thresholds[None, :])

    def score(self, texts: list[bytes]) -> list[np.ndarray]:
        up = self.above(texts)
        p = -np.diff(np.column_stack([np.ones(len(up)), up, np.zeros(len(up))]), axis=1)
        return [up.sum(axis=1), p.argmax(axis=1).astype(np.int32), up[:, 0]]


def grades_of(doc, index, value, toxic, size: int, grades: int = GRADES) -> np.ndarray:
    """Severity grades for training: 0 for label 0, the others for label 1 in equal parts by how surely a model that has not seen the document calls it toxic.

    The labels have two values only.  The documents are dealt to two halves by turns; a regression with one threshold is
    fitted to each half and ranks the toxic documents of the other, so no document's grade rests on its own wording.
    """
    half, load = np.arange(len(toxic)) % 2, np.zeros(len(toxic))
    for own in (0, 1):
        at = np.flatnonzero(half == own)
        seen = half[doc] == own
        model = OrdinalRegression(size, 2).fit(np.searchsorted(at, doc[seen]), index[seen], value[seen], toxic[at])
        load += np.where(half == own, 0.0, np.bincount(doc, model._weight(index) * value, len(toxic)))
    grade = np.zeros(len(toxic), np.int64)
    own = np.flatnonzero(toxic == 1)
    if len(own):
        rank = np.argsort(np.argsort(load[own], kind="stable"), kind="stable")
        grade[own] = 1 + rank * (grades - 1) // len(own)
    return grade


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalRegression:
    """Fits on at most ``sample`` labelled documents (labels: doc_id, toxic), chosen by a hash of the id."""
    prepare(docs.sparkSession)

    def fit(doc, index, _, count, stats, words, toxic):
        value = weigh(count)
        return OrdinalRegression().fit(doc, index, value, grades_of(doc, index, value, toxic, SIZE))

    return fit_sample(docs, sample_ids(labels, "toxic", sample), SIZE, PREFIX, fit)


def severity(docs: DataFrame, model: OrdinalRegression, columns: list[str]) -> DataFrame:
    """columns of docs with severity (expected grade, 0 to 3), grade (the likeliest) and toxic_score (probability of a grade above 0).

    Every whole text counts; a null text is scored as an empty one.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # a size fixed by SIZE
    return score_texts(docs, columns, "severity double, grade int, toxic_score double", lambda texts: shared.value.score(texts))
