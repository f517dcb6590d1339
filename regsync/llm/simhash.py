"""Near duplicates by 64-bit SimHash fingerprints, found through pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.components import connected_components
from .common import as_bytes, map_arrow, prepare, released

#: A block key with more distinct fingerprints than this is divided by further blocks.
LARGE = 256
_PART = 1 << 15


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles (A-Z lower-cased, repeats count); no words: 0."""
    own = (text or b"").lower().split()
    if not own:
        return 0
    size = min(words, len(own))
    shingles = map(b" ".join, zip(*(own[i:] for i in range(size)), strict=False))
    digest, total = xxhash.xxh64_intdigest, len(own) - size + 1
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64, total))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, total, _PART):
        part = np.ascontiguousarray(hashes[i : i + _PART]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        own = np.array([fingerprint(t) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs, ["doc_id", "text"], _fingerprints, f"doc_id {kind}, fp bigint")


def _signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def _forest(batches, distance: int = 2):
    """Links of each run of equal (k, x, y) to the run's smallest linked fingerprint; input sorted by k, x, y, fp."""
    held: list[np.ndarray] | None = None

    def links(cols):
        k, x, y, fp = cols
        n = len(fp)
        same = (k[1:] == k[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        run = np.concatenate(([0], np.cumsum(~same)))
        u = fp.view(np.uint64)
        a, b = [], []
        lag = 1
        while lag < n:
            alike = np.flatnonzero(run[lag:] == run[:-lag])
            if not len(alike):
                break
            near = alike[np.bitwise_count(u[alike] ^ u[alike + lag]) <= distance]
            a.append(near)
            b.append(near + lag)
            lag += 1
        if not a or not sum(map(len, a)):
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        root = np.arange(n)
        while True:  # labels fall until all ends of links agree
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, root, new)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
        if not len(cols[3]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        held = [c[cut:] for c in cols]
        if cut and (out := links([c[:cut] for c in cols])) is not None:
            yield out
    if held is not None and len(held[3]) and (out := links(held)) is not None:
        yield out


def block_rows(prints: DataFrame) -> DataFrame:
    """(k, x) and prints' columns: six rows for each fingerprint ``fp``, by two of its four 16-bit blocks."""
    masks = [_signed(sum(0xFFFF << 16 * j for j in range(4) if j not in gone)) for gone in combinations(range(4), 2)]
    first = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("x")) for i, m in enumerate(masks)]
    return prints.withColumn("s", F.explode(F.array(*first))).select("s.k", "s.x", *prints.columns)


def blocks(prints: DataFrame) -> DataFrame:
    """(k, x, y) and prints' columns: rows whose fingerprints ``fp`` differ in at most 2 bits have one (k, x, y) in common.

    Of four blocks of 16 bits two must be equal: six keys for each fingerprint.  Fingerprints of a key
    that more than ``LARGE`` rows share are dealt again: of the eight 4-bit blocks of the two free 16-bit
    blocks six must be equal, so no key holds more than 2^8 fingerprints and all are compared.
    """
    keyed = block_rows(prints)
    large = keyed.groupBy("k", "x").count().where(F.col("count") > LARGE).select("k", "x", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["k", "x"], "left")
    few = keyed.where("large is null").select("k", "x", F.lit(0).cast("long").alias("y"), *prints.columns)
    choices = []  # the blocks that may differ, by the choice k of the first level
    for k, gone in enumerate(combinations(range(4), 2)):
        free = [(16 * g + 4 * j) for g in gone for j in range(4)]
        fine = []
        for i, out in enumerate(combinations(free, 2)):
            mask = _signed(sum(0xF << at for at in free if at not in out))
            fine.append(F.struct(F.lit(10 + 28 * k + i).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("y")))
        choices.append(F.when(F.col("k") == k, F.array(*fine)))
    many = keyed.where("large").withColumn("s", F.explode(F.coalesce(*choices))).select("s.k", "x", "s.y", *prints.columns)
    return few.unionByName(many)


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): a forest that joins all distinct fingerprints ``fp`` differing in at most 2 bits."""
    dealt = blocks(prints).repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "fp")
    return dealt.mapInArrow(_forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, class_fp, component_id) for each row of docs (doc_id, text).

    Texts whose fingerprints differ in at most 2 bits are linked; class_fp is one fingerprint of the
    component, component_id its smallest doc_id.  Null texts count as empty (fingerprint 0); a null
    doc_id is never smallest, so component_id is null only where all the component's ids are null.
    Repeated rows return repeated rows.  Distinct fingerprints, not rows, are compared.
    """
    prepare(docs.sparkSession)
    return classes_of(fingerprints(docs).checkpoint(), lambda classes: near_links(classes.select("fp")))


def classes_of(own: DataFrame, links) -> DataFrame:
    """(doc_id, fp, class_fp, component_id) for rows (doc_id, fp), by the links that ``links`` makes of the distinct fp."""
    with released(own.sparkSession):  # what the links were dealt by isn't needed any more
        classes = own.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
        roots = connected_components(links(classes))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("class_fp"))
    least = classes.groupBy("class_fp").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "class_fp").select("fp", "class_fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "class_fp", "component_id")


def keep_first(docs: DataFrame, found: DataFrame, prints) -> DataFrame:
    """One row of docs for each class of ``found``: with the smallest doc_id, of several such the smallest fp.

    ``prints`` gives the fp of a column of texts, so that a row can stand only for its own class, whatever rows share its id
    or have none.  docs may have any further columns.  Of several rows with this id and fp the one whose text has the
    least XXH64 stays, of equal texts the one whose columns (but for maps) together have, so the layout decides nothing.
    """
    kept = found.where("doc_id <=> component_id").groupBy("class_fp").agg(F.min(F.struct("fp", "doc_id")).alias("k")).select(F.col("k.fp").alias("kept_fp"), F.col("k.doc_id").alias("kept_id"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, own_id = docs.columns.index("text"), names[docs.columns.index("doc_id")]

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints(b.column(text)), pa.int64())], [*names, "own_fp"])

    plain = docs.toDF(*names)
    rows = plain.mapInArrow(work, StructType([*plain.schema.fields, StructField("own_fp", LongType())]))
    rows = rows.join(kept, (F.col("own_fp") == F.col("kept_fp")) & F.col(own_id).eqNullSafe(F.col("kept_id")))
    hashed = [f.name for f in plain.schema.fields if "map<" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*names), F.struct(F.xxhash64(names[text]), F.xxhash64(*hashed)))
    rows = rows.groupBy("own_fp").agg(first.alias("r"))
    return rows.select(*[F.col(f"r.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _signed_prints(column) -> list[int]:
    return np.array([fingerprint(t) for t in as_bytes(column)], np.uint64).view(np.int64)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one for each component of near duplicates, the one with the smallest doc_id."""
    return keep_first(docs, near_duplicates(docs), _signed_prints)
