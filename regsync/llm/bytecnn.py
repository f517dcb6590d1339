"""Language identification: a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, as_bytes, prepare, steps
from .features import fit_in_task

#: Bytes of a window, widths of the filters, filters of a width, numbers of a byte's embedding.
LENGTH, WIDTHS, FILTERS, EMBEDDING = 192, (2, 3, 4, 5), 16, 8
#: Documents of a language that training uses at most, and the factor that bounds the sample of all languages.
SAMPLE, LANGUAGES = 1200, 200
#: Windows of a text that training uses at most: 11 KB of its bytes.
TEXT_WINDOWS = 64
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")
_CHUNK = 32


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def windows(text: bytes, length: int = LENGTH, overlap: int = max(WIDTHS) - 1) -> np.ndarray:
    """All windows of a text, A-Z lower-cased, each overlapping the one before by ``overlap`` bytes; the last is filled with zeros."""
    buf = _LOWER[np.frombuffer(text, np.uint8)]
    stride = length - overlap
    n = max(1, -(-(len(buf) - overlap) // stride))
    full = np.zeros((n - 1) * stride + length, np.uint8)
    full[: len(buf)] = buf
    return as_strided(full, (n, length), (stride, 1)).copy()


def spread_windows(text: bytes, most: int, length: int = LENGTH, overlap: int = max(WIDTHS) - 1) -> np.ndarray:
    """``windows`` of a text, of more than ``most`` that many at even distances from the first to the last."""
    stride = length - overlap
    n = max(1, -(-(len(text) - overlap) // stride))
    if n <= most:
        return windows(text, length, overlap)
    out = np.zeros((most, length), np.uint8)
    for row, k in zip(out, np.linspace(0, n - 1, most).round().astype(np.int64), strict=True):
        part = _LOWER[np.frombuffer(text[k * stride : k * stride + length], np.uint8)]
        row[: len(part)] = part
    return out


class ByteCNN:
    """Embedding, filters of several widths, maximum over places, ReLU, softmax."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        k, width = len(WIDTHS) * FILTERS, max(WIDTHS)
        self.embed = (rng.standard_normal((256, EMBEDDING)) * 0.3).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((width * EMBEDDING, k), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters = (rng.standard_normal(self.mask.shape) * 0.25).astype(np.float32) * self.mask
        self.bias = np.zeros(k, np.float32)
        self.out = (rng.standard_normal((k, len(classes))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _places(self, x):
        n, length, width = len(x), x.shape[1], max(WIDTHS)
        e = np.ascontiguousarray(self.embed[x])
        view = as_strided(e, (n, length - width + 1, width * EMBEDDING), (e.strides[0], e.strides[1], 4))
        return np.ascontiguousarray(view)

    def pooled(self, x):
        places = self._places(x)
        n, m, d = places.shape
        act = (places.reshape(-1, d) @ self.filters).reshape(n, m, -1)
        return places, act

    def logits(self, x) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), _CHUNK):
            _, act = self.pooled(x[i : i + _CHUNK])
            out[i : i + _CHUNK] = np.maximum(act.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
        return out

    def fit(self, x, y, rounds: int = 700, batch: int = 64, rate: float = 4e-3, seed: int = 3):
        """Adam on the mean cross-entropy; as many rounds as let every window be seen once, ``rounds`` at least."""
        names = ("embed", "filters", "bias", "out", "out_bias")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        rng = np.random.default_rng(seed)
        rounds, order = max(rounds, -(-len(x) // batch)), np.zeros(0, np.int64)
        for t in range(1, rounds + 1):
            while len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(x))])
            own, order = order[:batch], order[batch:]
            xb, yb = x[own], y[own]
            places, act = self.pooled(xb)
            best = act.argmax(axis=1)
            top = np.take_along_axis(act, best[:, None, :], 1)[:, 0] + self.bias
            h = np.maximum(top, 0)
            z = h @ self.out + self.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            p /= batch
            dh = (p @ self.out.T) * (top > 0)
            picked = places[np.arange(batch)[:, None], best]
            grads = {"out": h.T @ p, "out_bias": p.sum(axis=0), "bias": dh.sum(axis=0), "filters": np.einsum("nkd,nk->dk", picked, dh) * self.mask}
            de = np.zeros_like(self.embed)
            back = (dh[:, :, None] * self.filters.T[None]).reshape(batch, -1, max(WIDTHS), EMBEDDING)
            for j in range(max(WIDTHS)):
                np.add.at(de, np.take_along_axis(xb, best + j, 1), back[:, :, j])
            de[0] = 0
            grads["embed"] = de
            step = rate * min(1.0, 2 * (1 - t / (rounds + 1)))
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(self, k, (getattr(self, k) - move).astype(np.float32))
        return self

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """The language of each whole text, by the mean of its windows' log probabilities, and its share of the probability."""
        names, scores = [], []
        for start, held in steps(texts, 1 << 18):
            live = [i for i, t in enumerate(held) if has_letter(texts[start + i])]
            name, score = [UNKNOWN] * len(held), [0.0] * len(held)
            if live and self.classes:
                x = [windows(held[i]) for i in live]
                heads = np.cumsum([0, *map(len, x[:-1])])
                z = self.logits(np.concatenate(x)).astype(float)
                z -= np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + z.max(axis=1, keepdims=True)
                mean = np.add.reduceat(z, heads, axis=0) / np.array([len(w) for w in x])[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, row in zip(live, p, strict=True):
                    k = int(row.argmax())
                    name[i], score[i] = self.classes[k], float(row[k])
            names += name
            scores += score
        return names, scores


def train(docs: DataFrame, learn=None, sample: int = SAMPLE, most: int = TEXT_WINDOWS) -> ByteCNN:
    """Learns from text and lang of the rows where ``learn`` holds: at most ``sample`` documents of a language, chosen by a hash of the id.

    Of a text with more than ``most`` windows that many teach, from all over it.  Rows without an id, text, letters or lang
    teach nothing.  Of very many languages the sample holds ``sample * LANGUAGES`` documents.  Of several rows with one
    id and lang the text with the least hash teaches.  The windows are cut where the texts lie; the network is trained
    on them in one task, whose bytes and rounds these parameters bound.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        known = known.where(learn)
    # a language may hold most rows: its parts are cut to the sample first, so the second window sees 8 * sample rows at most
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for keys, most in ((["lang", "part"], max(1, sample // 8)), (["lang"], sample)):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("r") <= most)
    ids = ids.orderBy("r", "lang").limit(sample * LANGUAGES).select("doc_id", "lang")
    chosen = known.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])
    one = chosen.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("r.text", "lang")

    def cut(batches):
        for b in batches:
            rows = [(spread_windows(t, most).tobytes(), name) for t, name in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.string())], ["windows", "lang"])

    def fit(batches):
        rows = sorted((name, w) for b in batches for w, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        classes = sorted({name for name, _ in rows})
        model = ByteCNN(classes)
        if not rows:
            return model
        x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, LENGTH)
        return model.fit(x, np.repeat([classes.index(name) for name, _ in rows], [len(w) // LENGTH for _, w in rows]))

    return fit_in_task(one.mapInArrow(cut, "windows binary, lang string"), fit)


def languages(docs: DataFrame, model: ByteCNN, columns: list[str]) -> DataFrame:
    """columns of docs with lang_pred and score for every whole text; null texts and texts without a letter: und, 0."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # some 50 KB
    kinds = dict(docs.dtypes)

    def work(batches):
        for b in batches:
            names, scores = shared.value.predict(as_bytes(b.column("__text")))
            own = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["lang_pred string, score double"])
    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(work, schema)


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs that are in a learned language: predicted with a score of ``least`` or more."""
    model = train(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = languages(plain, model, names).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
