"""Document fingerprints by Order MinHash, which are sensitive to edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, prepare

#: Code points of a k-mer (a power of two), signatures of a fingerprint, k-mers of a signature.
K, SIGNATURES, TUPLE = 8, 64, 2
#: Characters of a range of documents, about, and ranges at most (larger inputs have longer ranges).
RANGE_CHARS, RANGES = 16 << 20, 50_000
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 4096
_rng = np.random.default_rng(77)
_FLIP = _rng.integers(0, 2**32, SIGNATURES, dtype=np.uint64).astype(np.uint32)
_TURN = _rng.integers(0, 2**31, SIGNATURES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def kmers(text: str) -> np.ndarray:
    """A 32-bit hash of each k-mer with its occurrence number, in text order; a text shorter than K is one k-mer."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    if not len(c):
        return np.zeros(0, np.uint32)
    if len(c) < K:
        c = np.concatenate([c, np.zeros(K - len(c), U64)])
    h, size = c, 1
    while size < K:
        h = h[:-size] * U64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h = mix(h)
    n = len(h)
    place = np.argsort(h, kind="stable")
    group = h[place]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    if not first.all():
        heads = np.flatnonzero(first)
        number = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        more = number > 0
        h[place[more]] += number[more].astype(U64) * U64(0xD1342543DE82EF95)
    return (mix(h) >> U64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """SIGNATURES numbers: for each permutation the TUPLE least k-mers, put in text order and hashed; empty: zeros."""
    x = kmers(text)
    n = len(x)
    if not n:
        return np.zeros(SIGNATURES, np.uint32)
    take = min(TUPLE, n)
    rows = np.arange(SIGNATURES)
    value = np.full((SIGNATURES, 0), 0, np.uint64)
    place = np.zeros((SIGNATURES, 0), np.int64)
    for a in range(0, n, _BLOCK):
        v = (x[None, a : a + _BLOCK] ^ _FLIP[:, None]) * _TURN[:, None]
        got_v, got_p = [value], [place]
        for _ in range(min(take, v.shape[1])):
            at = v.argmin(axis=1)
            got_v.append(v[rows, at].astype(np.uint64)[:, None])
            got_p.append(at[:, None] + a)
            v[rows, at] = 0xFFFFFFFF
        value, place = np.concatenate(got_v, axis=1), np.concatenate(got_p, axis=1)
        if value.shape[1] > take:
            best = np.argsort(value, axis=1, kind="stable")[:, :take]
            value, place = np.take_along_axis(value, best, 1), np.take_along_axis(place, best, 1)
    place.sort(axis=1)
    out = np.zeros(SIGNATURES, U64)
    for i in range(place.shape[1]):
        out = mix(out + x[place[:, i]].astype(U64) + U64(i + 1))
    return (out >> U64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal signatures, which estimates how alike the texts' k-mers and their order are."""
    return float((a == b).mean())


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many of the first code points of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _stream(batches):
    """Pairs each row with the next of its range; the input is sorted by range, copies last."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    now, before, after, out = None, None, None, []

    def close(row, text, print_):
        doc_id, own, mine = row
        new = edited(own, text)
        if after is None or new != after[0]:
            again(new)
        changed = after[1]
        out.append((doc_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine), as_text(changed), likeness(mine, changed), likeness(mine, print_)))

    def again(new):
        nonlocal after
        after = new, fingerprint(new)

    def batch():
        cols = list(zip(*out, strict=True))
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)
        out.clear()
        return made

    kind = pa.int64()
    for b in batches:
        kind = b.schema.field("doc_id").type
        for bucket, copy, doc_id, text in zip(b.column("bucket").to_pylist(), b.column("copy").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            if bucket != now:
                now, before = bucket, None
            elif before is None:
                continue  # a further copy
            print_ = before[2] if before is not None and before[1] == text else fingerprint(text)  # repeated rows cost little
            if before is not None:
                close(before, text, print_)
            before = None if copy else (doc_id, text, print_)
        if out:
            yield batch()


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Rows (bucket, copy, doc_id, tie, text): ranges of documents in descending order, one to a partition, each followed by a copy of the next one's first row.

    Rows with the same id follow each other by a hash of their text, so that very many rows with one id are many ranges
    too; a null id is the smallest.  A first job ranges ids and hashes only; each range's first key is all that the driver
    sees.  Texts are shuffled once.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    key = F.struct("doc_id", "tie")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = min(max(8, -(-chars // range_chars)), RANGES)
    ranged = rows.select("doc_id", "tie").repartitionByRange(wanted, F.desc_nulls_last("doc_id"), F.desc("tie"))
    heads = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("head")).select("head").distinct().checkpoint()
    size = heads.count()
    heads = heads.agg(F.sort_array(F.collect_list("head"), asc=False).alias("heads")).scalar()
    # the number of range heads at or above the key, by halving steps
    rows = rows.withColumn("low", F.lit(0))
    for step in [1 << k for k in reversed(range(max(1, size.bit_length())))]:
        more = F.col("low") + step
        rows = rows.withColumn("low", F.when((more <= size) & (F.get(heads, more - 1) >= key), more).otherwise(F.col("low")))
    rows = rows.select("doc_id", "tie", "text", (F.col("low") - 1).alias("bucket"))
    first = F.get(heads, F.col("bucket")) == key  # also goes after the range before; the first of all follows the last
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.when(first, F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(size, 1))).alias("bucket"), F.lit(True).alias("copy"))))
    rows = rows.select("doc_id", "tie", "text", F.explode(places).alias("p")).where("p is not null").select("p.bucket", "p.copy", "doc_id", "tie", "text")
    return rows.repartitionById(max(size, 1), "bucket").sortWithinPartitions("copy", F.desc_nulls_last("doc_id"), F.desc("tie"))


def fingerprints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """For each row of docs (doc_id, text; null text: empty) the fingerprints of its text and of its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Empty
    texts have a fingerprint of zeros, like only to itself.  One row alone is its own next document.  Ids may be of any
    type that can be ordered; other columns are not read.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, range_chars).select("bucket", "copy", "doc_id", "text").mapInArrow(_stream, schema)
