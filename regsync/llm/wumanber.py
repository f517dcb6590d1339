"""Benchmark decontamination: Wu-Manber search for all word windows of the benchmark at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, as_bytes, mix, new_folder, prepare, steps

#: Words of a window; an item with fewer is one window.
WINDOW = 13
#: Benchmark words that one search index holds at most (about 60 bytes each, besides their text); more items make more indexes, searched one after the other.
INDEX_WORDS = 2_000_000
#: Other bytes than a-z, 0-9 and those over 7F part words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_K = U64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


class Sequence:
    """The words of some texts: joined by single spaces, with each word's place and hash, and each text's first word."""

    def __init__(self, texts: list[bytes | None]):
        own = Words([b" ".join(words_of(t)) for t in texts], lower=False)
        self.text, self.hash, self.count = own.raw.tobytes(), own.hash, own.count
        self.start = own.start.astype(np.int64)
        self.stop = self.start + own.length
        self.first = np.cumsum(own.count) - own.count

    def window(self, at: int, size: int) -> bytes:
        return self.text[self.start[at] : self.stop[at + size - 1]]


def _blocks_of(h: np.ndarray, block: int) -> np.ndarray:
    """The hash of the block that ends at each word; the first word of two has none of its own."""
    if block == 1 or not len(h):
        return h
    return mix(np.concatenate((h[:1], h[:-1])) * _K + h)


def _windows_of(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    own = h[at].copy()
    for i in range(1, size):
        own = own * _K + h[at + i]
    return mix(own)


class Patterns:
    """Wu-Manber tables for all windows of ``size`` words of some items, as sorted arrays over one word sequence.

    The block is two words (one if the size is 1).  ``shift`` holds how far the search may move when a block
    stands under the window's end; blocks that end a window have shift 0 and a bucket.  Buckets are sorted by the
    windows' hashes, which select test strings; the bytes are then compared directly.
    """

    def __init__(self, words: Sequence, items: np.ndarray, size: int):
        self.words, self.size, self.block = words, size, min(2, size)
        self.far = size - self.block + 1
        count, first = words.count[items], words.first[items]
        item = np.repeat(items, count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first, count) + nth
        own = words.hash[at]
        bits = min(24, max(10, 3 + int(len(own)).bit_length()))
        self.mask = U64((1 << bits) - 1)
        self.known = np.zeros(1 << bits, bool)
        self.known[own & self.mask] = True
        blocks = _blocks_of(words.hash, self.block)
        ends = nth >= self.block - 1
        key, shift = blocks[at[ends]], np.maximum(size - 1 - nth[ends], 0).astype(np.uint8)
        order = np.lexsort((shift, key))
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        self.blocks, self.shift = key[order][new], shift[order][new]
        starts = nth <= np.repeat(count, count) - size
        at, item = at[starts], item[starts]
        rank = np.searchsorted(self.blocks, blocks[at + size - 1]).astype(U64)
        bucket = rank << U64(32) | _windows_of(words.hash, at, size) >> U64(32)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.at, self.item = bucket[order], at[order].astype(np.uint32), item[order].astype(np.uint32)

    def search(self, doc: Sequence, k: int, hit: np.ndarray, found: set) -> None:
        """Marks the words of text k of ``doc`` that lie in a window, and adds the windows' items."""
        size, n, first = self.size, int(doc.count[k]), int(doc.first[k])
        if n < size:
            return
        h = doc.hash[first : first + n]
        known = self.known[h & self.mask]
        move = np.where(known, np.uint8(self.far), np.uint8(size))
        here = np.flatnonzero(known[self.block - 1 :] & known[: n - self.block + 1]) + self.block - 1
        blocks = _blocks_of(h, self.block)
        rank = np.minimum(np.searchsorted(self.blocks, blocks[here]), len(self.blocks) - 1)
        same = self.blocks[rank] == blocks[here]
        move[here[same]] = self.shift[rank[same]]
        far, end, stops = move.tobytes(), size - 1, []
        while end < n:
            step = far[end]
            if step:
                end += step
            else:
                stops.append(end)
                end += 1
        if not stops:
            return
        at = np.array(stops) - size + 1
        rank = np.searchsorted(self.blocks, blocks[stops]).astype(U64)
        key = rank << U64(32) | _windows_of(h, at, size) >> U64(32)
        low, high = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        for i in np.flatnonzero(high > low):
            text, start = doc.window(first + int(at[i]), size), at[i]
            for j in range(low[i], high[i]):
                if self.words.window(int(self.at[j]), size) == text:
                    hit[start : start + size] = 1
                    found.add(int(self.item[j]))


class Index:
    """All windows of some items (item_id as text, text): tables for each length, so that a short item shortens no other's shifts."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        words = Sequence([text for _, text in items])
        size = np.minimum(words.count, window)
        self.tables = [Patterns(words, np.flatnonzero(size == s), int(s)) for s in np.unique(size[size > 0])]

    def search(self, doc: Sequence, k: int, hit: np.ndarray) -> set[str]:
        found: set[int] = set()
        for table in self.tables:
            table.search(doc, k, hit, found)
        return {self.names[i] for i in found}


def _parts_of(benchmark: DataFrame, most: int):
    """The items in parts of about ``most`` words, one at a time, read one partition at a time; always at least one."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("n"), F.col("text").cast("binary").alias("t"))
    held, total = [], 0
    for row in rows.toLocalIterator():
        text = bytes(row.t) if row.t is not None else b""
        n = len(words_of(text))
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append((row.n, text))
        total += n
    yield held


def _searched(batches, shared, last: bool):
    index = shared.value
    for b in batches:
        row = b.column("row")
        texts = as_bytes(row.field("text"))
        before, listed = b.column("hit").to_pylist(), b.column("items").to_pylist()
        hits, items = [], []
        for start, own in steps(texts):
            doc = Sequence(own)
            for k in range(len(own)):
                old = before[start + k]
                hit = np.frombuffer(old, np.uint8).copy() if old else np.zeros(int(doc.count[k]), np.uint8)
                items.append(sorted(index.search(doc, k, hit).union(listed[start + k] or ())))
                hits.append(hit)
        named = pa.array(items, pa.list_(pa.string()))
        if last:
            yield pa.RecordBatch.from_arrays([row, pa.array([len(h) for h in hits], pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), named], ["row", "n_words", "n_hit", "items"])
        else:
            yield pa.RecordBatch.from_arrays([row, pa.array([h.tobytes() for h in hits], pa.binary()), named], ["row", "hit", "items"])


def _rows_searched(docs: DataFrame, benchmark: DataFrame, window: int, index_words: int) -> DataFrame:
    """(row, n_words, n_hit, items): row is the struct of docs' columns."""
    spark = prepare(docs.sparkSession)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    own, names = out.schema["row"], out.schema["items"]
    whole = T.StructType([own, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), names])
    parts = _parts_of(benchmark, index_words)
    part = next(parts)
    while part is not None:
        following = next(parts, None)
        shared = spark.sparkContext.broadcast(Index(part, window))
        last = following is None
        out = out.mapInArrow(lambda b, shared=shared, last=last: _searched(b, shared, last), whole if last else T.StructType([own, T.StructField("hit", T.BinaryType()), names]))
        if not last:
            path = new_folder(spark, "searched")
            out.write.mode("overwrite").parquet(path)
            out = spark.read.parquet(path)
            shared.unpersist()
        part = following
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_words: int = INDEX_WORDS) -> DataFrame:
    """docs with the columns n_words, n_hit (longs) and items (sorted array of item ids as strings).

    A document word is hit if it lies in an occurrence of ``window`` consecutive words of an item (of the
    whole item if that is shorter).  Null texts have no words; items without words or without an id never
    occur; repeated items count once.  docs' own columns of these names are replaced; all others are kept, whatever
    their names.  The benchmark is the stated query set: its windows are indexed in parts of ``index_words`` words, one
    after the other, so what the driver holds and broadcasts is bounded (a single larger item makes a larger part).
    Between parts the rows are written to the shared folder; one part, the usual case, is one narrow pass without a shuffle.
    """
    return _rows_searched(docs.drop("n_words", "n_hit", "items"), benchmark, window, index_words).select("row.*", "n_words", "n_hit", "items")


def contaminated():
    """The contract's rule as a column: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' columns."""
    return _rows_searched(docs, benchmark, window, index_words).where(~contaminated()).select("row.*")
