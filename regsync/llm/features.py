"""Sparse word features and structure statistics of whole texts, and bounded training samples."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, U64, Words, as_bytes, mix, steps

#: Names of the structure statistics.
STATISTICS = ("log_chars", "log_words", "mean_length", "upper", "digit", "symbol", "non_ascii", "line_ends", "distinct", "top_share", "repeated", "bare_symbols", "closed_by_symbol", "double_mark", "words_by_line", "long_words")

_RAW = np.arange(256)
_IS_UPPER = (_RAW >= 65) & (_RAW <= 90)
_IS_LOWER = (_RAW >= 97) & (_RAW <= 122)
_IS_DIGIT = (_RAW >= 48) & (_RAW <= 57)
_IS_HIGH = _RAW >= 128
_IS_ALNUM = _IS_UPPER | _IS_LOWER | _IS_DIGIT | _IS_HIGH
_IS_SYMBOL = (_RAW > 32) & (_RAW < 127) & ~_IS_ALNUM & (_RAW != 44) & (_RAW != 46)
_IS_SYMBOL_WORD = (_RAW > 32) & ~_IS_ALNUM


class Sparse:
    """For n texts: (doc, index, value) of the hashed features, doc ascending, and a row of statistics for each text."""

    def __init__(self, texts: list[bytes], size: int, prefixes: int = 0):
        words = Words(texts)
        n = len(texts)
        code = words.hash & U64(size - 1)
        key = words.doc.astype(np.int64) * size + code.astype(np.int64)
        if prefixes:
            # the first bytes of the word's core: from its first letter or digit up to the next sign
            low, stop = words.low, words.start + words.length
            core = np.append(np.flatnonzero(_IS_ALNUM[low]), len(low))
            begin = np.minimum(core[np.searchsorted(core, words.start)], stop)
            sign = np.append(np.flatnonzero(~_IS_ALNUM[low]), len(low))
            at = np.minimum(np.minimum(sign[np.searchsorted(sign, begin)], stop) - begin, prefixes)
            head = np.zeros(len(at), U64)
            for i in range(prefixes):
                head = mix(head + low[np.minimum(begin + i, len(low) - 1)].astype(U64) * (i < at)) if len(at) else head
            start = words.doc.astype(np.int64) * size + (mix(head + U64(7)) & U64(size - 1)).astype(np.int64)
            key = np.concatenate([key, start])
        key, count = np.unique(key, return_counts=True)
        self.doc, self.index = key // size, key % size
        total = np.maximum(words.count, 1)
        value = np.sqrt(count / total[self.doc])
        self.value = value.astype(np.float32)
        self.count = count
        self.words = words.count
        self.n = n
        self.stats = self._statistics(texts, words, n)

    def _statistics(self, texts, words, n) -> np.ndarray:
        raw, ends = words.raw, words.ends
        if not n:
            return np.zeros((0, len(STATISTICS)), np.float32)
        heads = np.concatenate(([0], ends[:-1]))
        size = np.maximum(ends - heads - 1, 1).astype(float)
        total = np.maximum(words.count, 1).astype(float)
        by_text = lambda flag: np.add.reduceat(flag.astype(np.int32), heads).astype(float)
        by_word = lambda weight: np.bincount(words.doc, weight, minlength=n) if len(words.doc) else np.zeros(n)
        lines = by_text(raw == 10) + 1
        doubled = np.zeros(len(raw), bool)
        doubled[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
        last = _IS_SYMBOL[raw[np.maximum(words.start + words.length - 1, 0)]]
        first_alnum = _IS_ALNUM[raw[words.start]] if len(words.start) else np.zeros(0, bool)
        again = np.zeros(len(words.hash), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        kinds = np.bincount(self.doc, minlength=n) if len(self.doc) else np.zeros(n)
        top = np.zeros(n)
        np.maximum.at(top, self.doc, self.count)
        columns = (
            np.log1p(size), np.log1p(words.count), by_word(words.length) / total, by_text(_IS_UPPER[raw]) / size, by_text(_IS_DIGIT[raw]) / size, by_text(_IS_SYMBOL[raw]) / size,
            by_text(_IS_HIGH[raw]) / size, lines / total, kinds / total, top / total, by_word(again) / total, by_word(~first_alnum & (words.length <= 3)) / total, by_word(last) / total,
            by_text(doubled) / size, np.log1p(total / lines), by_word(words.length > 12) / total,
        )
        return np.column_stack(columns).astype(np.float32)


def sample_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label): at most ``most`` labelled ids in the order of a hash; labels of repeated ids are averaged and rounded."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_in_task(rows: DataFrame, fit):
    """The model that ``fit(record batches)`` makes of a bounded table, fitted in one task, so that the driver gets the model only."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(list(batches)))], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(made.model)) if made else fit([])  # noqa: S301  written by our own task


def fit_sample(docs: DataFrame, ids: DataFrame, size: int, prefixes: int, fit):
    """``fit(doc, index, value, count, stats, words, label)`` over the whole texts of the sampled documents, in one task.

    ids is bounded, so its broadcast and the task's rows are bounded too (not the length of a text, of which only the
    distinct features are held).  Of several rows with one id the text with the least hash teaches, whatever the layout.
    """

    def work(batches):
        for b in batches:
            for t, label in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                s = Sparse([t or b""], size, prefixes)
                row = [s.index.astype(np.int32).tobytes(), s.count.astype(np.int32).tobytes(), s.stats.tobytes(), int(s.words[0]), label]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in row[:3]], pa.array([row[3]], pa.int64()), pa.array([row[4]], pa.int32())], ["i", "c", "s", "w", "y"])

    def learn(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[2], r[0], r[1], r[4]))
        n = len(rows)
        index = np.frombuffer(b"".join(r[0] for r in rows), np.int32).astype(np.int64)
        count = np.frombuffer(b"".join(r[1] for r in rows), np.int32)
        doc = np.repeat(np.arange(n), [len(r[0]) // 4 for r in rows])
        stats = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(n, len(STATISTICS))
        words, label = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
        del rows
        value = np.sqrt(count / np.maximum(words, 1)[doc]).astype(np.float32) if n else np.zeros(0, np.float32)
        return fit(doc, index, value, count, stats, words, label)

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = chosen.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")).select("r.text", "r.label")
    return fit_in_task(one.mapInArrow(work, "i binary, c binary, s binary, w bigint, y int"), learn)


def score_texts(docs: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """docs.columns plus what ``work(texts) -> list of arrays`` gives for each step of texts; text itself isn't returned."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = dict(docs.dtypes)
    full = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [schema])

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column("__text"))
            parts = [work(t) for _, t in steps(texts)]
            made = [np.concatenate(p) for p in zip(*parts, strict=True)]
            own = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x) for x in made]], [*columns, *names])

    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, full)


__all__ = ["STATISTICS", "Sparse", "fit_in_task", "fit_sample", "sample_ids", "score_texts", "_LOWER"]
