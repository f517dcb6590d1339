"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .features import STATISTICS, Sparse, fit_sample, sample_ids, score_texts

#: Places of the hashed words, factors of a feature, labelled documents learned from at most.
SIZE, FACTORS, SAMPLE = 1 << 15, 8, 12_000


def _sum(doc, values, n):
    """Sums of the rows of ``values`` by doc (ascending)."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(doc):
        heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        out[doc[heads]] = np.add.reduceat(values, heads, axis=0)
    return out


class FactorisationMachine:
    """score = w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), which takes time linear in the features of x."""

    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        total = size + len(STATISTICS)
        self.size, self.total = size, total
        self.bias = np.float32(0)
        self.w = np.zeros(total, np.float32)
        self.v = (rng.standard_normal((total, factors)) * 0.02).astype(np.float32)
        self.mean = np.zeros(len(STATISTICS), np.float32)
        self.spread = np.ones(len(STATISTICS), np.float32)

    def _dense(self, stats):
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def raw(self, doc, index, value, stats, n):
        z = self._dense(stats)
        v, x = self.v[index], value[:, None]
        s = _sum(doc, v * x, n) + z @ self.v[self.size :]
        q = _sum(doc, (v * x) ** 2, n) + (z * z) @ (self.v[self.size :] ** 2)
        line = _sum(doc, self.w[index] * value, n) + z @ self.w[self.size :]
        return self.bias + line + 0.5 * (s * s - q).sum(axis=1), s, z

    def fit(self, doc, index, value, stats, label, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, batch: int = 64, seed: int = 11):
        n = len(label)
        if not n:
            return self
        self.mean, self.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        rate_of = np.clip(label.mean(), 0.01, 0.99)
        self.bias = np.float32(np.log(rate_of / (1 - rate_of)))
        heads = np.searchsorted(doc, np.arange(n + 1))
        gw, gv, gb = np.full(self.total, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        rng = np.random.default_rng(seed)
        at_stats = np.arange(self.size, self.total)
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                own = np.sort(order[i : i + batch])
                spans = [np.arange(heads[d], heads[d + 1]) for d in own]
                at = np.concatenate(spans)
                d = np.repeat(np.arange(len(own)), [len(s) for s in spans])
                idx, x = index[at], value[at]
                score, s, z = self.raw(d, idx, x, stats[own], len(own))
                off = ((1 / (1 + np.exp(-np.clip(score, -30, 30)))) - label[own]).astype(np.float32) / len(own)
                e = off[d] * x
                grad_v = e[:, None] * (s[d] - self.v[idx] * x[:, None])
                places, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, e, len(places)).astype(np.float32) + decay * self.w[places]
                dv = np.column_stack([np.bincount(back, grad_v[:, f], len(places)) for f in range(self.v.shape[1])]).astype(np.float32) + decay * self.v[places]
                zs = (off[:, None] * z).sum(axis=0) + decay * self.w[at_stats]
                zv = (off[:, None, None] * (z[:, :, None] * s[:, None, :] - (z * z)[:, :, None] * self.v[at_stats])).sum(axis=0) + decay * self.v[at_stats]
                places, dw, dv = np.concatenate([places, at_stats]), np.concatenate([dw, zs]), np.concatenate([dv, zv])
                gw[places] += dw * dw
                gv[places] += dv * dv
                gb += float(off.sum()) ** 2
                self.w[places] -= rate * dw / np.sqrt(gw[places])
                self.v[places] -= rate * dv / np.sqrt(gv[places])
                self.bias -= np.float32(rate * off.sum() / np.sqrt(gb))
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        s = Sparse(texts, self.size)
        raw = self.raw(s.doc, s.index, s.value, s.stats, s.n)[0]
        return (1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fits on at most ``sample`` labelled documents (labels: doc_id, quality), chosen by a hash of the id."""
    prepare(docs.sparkSession)
    ids = sample_ids(labels, "quality", sample)
    return fit_sample(docs, ids, SIZE, 0, lambda doc, index, value, count, stats, words, label: FactorisationMachine().fit(doc, index, value, stats, label))


def quality_scores(docs: DataFrame, model: FactorisationMachine, columns: list[str]) -> DataFrame:
    """columns of docs and score (0 to 1) for every whole text; a null text counts as empty and gets the empty text's score."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # a size fixed by SIZE and FACTORS
    return score_texts(docs, columns, "score double", lambda texts: [shared.value.score(texts)])


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least ``least``."""
    model = train(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = quality_scores(plain, model, names).where(F.col("score") >= least)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
