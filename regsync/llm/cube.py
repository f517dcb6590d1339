"""Mixing sources to target weights: the cube method of balanced sampling, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, prepare

WEIGHTS = (3.0, 1.0, 2.0)
#: Units that one block of the flight phase starts with, about.
BLOCK = 2048
#: Sources up to which their table is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for the rows (source, size).

    Weights go round by the sources' order by code point, null last.  Targets share ``share`` times the
    total by weight and stop at ``most`` times their source's size; the excess is shared again.  That is
    min(cap, level x weight) at one common level, found by raising it over the sources not yet capped.
    Ranks come from a range sort and its partitions' counts, so no task sees all sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()).checkpoint()
    counts = {r.pid: r.n for r in ranged.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, run = {}, 0
    for pid in sorted(counts):
        before[pid], run = run, run + counts[pid]
    if not run:
        return totals.withColumn("target", F.lit(0.0))
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1 + offsets[F.col("pid")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = ranged.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).select("source", "source_size", "weight", "cap").checkpoint()
    goal = table.agg(F.sum("source_size")).first()[0] * share
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        done, open_weight = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        higher = (goal - done) / open_weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def flight(prob: np.ndarray, traits: np.ndarray, seed: int) -> np.ndarray:
    """Moves ``prob`` (each in [0, 1]) through the null space of the balance, until at most as many as there are traits stay fractional.

    traits: a row for each unit; sums of traits weighted by probability stay as they are.
    """
    prob = prob.astype(float).copy()
    rng = np.random.default_rng(seed)
    p = traits.shape[1]
    eps = 1e-9
    held: list[int] = []
    draws = rng.random(2 * len(prob) + 4).tolist()
    at = 0
    scale = np.abs(traits).max(axis=0) if len(traits) else np.ones(p)
    rows = (traits / np.where(scale > 0, scale, 1)).tolist()
    value = prob.tolist()
    for i in range(len(value)):
        if not eps < value[i] < 1 - eps:
            value[i] = float(value[i] > 0.5)
            continue
        held.append(i)
        while len(held) > p:
            u = _null([rows[j] for j in held])
            up = min((((1 - value[j]) / x) if x > 0 else (value[j] / -x)) for j, x in zip(held, u, strict=True) if x)
            down = min(((value[j] / x) if x > 0 else ((1 - value[j]) / -x)) for j, x in zip(held, u, strict=True) if x)
            step = up if draws[at] * (up + down) < down else -down
            at += 1
            rest = []
            for j, x in zip(held, u, strict=True):
                v = value[j] + step * x
                if v <= eps or v >= 1 - eps:
                    value[j] = float(v > 0.5)
                else:
                    value[j] = v
                    rest.append(j)
            if len(rest) == len(held):  # rounding kept all open: close the nearest
                j = min(rest, key=lambda j: min(value[j], 1 - value[j]))
                value[j] = float(value[j] > 0.5)
                rest.remove(j)
            held = rest
    return np.array(value)


def _null(rows: list[list[float]]) -> list[float]:
    """A vector that the rows' columns are orthogonal to: sum of u_j * rows[j] is 0."""
    if len(rows) == 3 and len(rows[0]) == 2:
        (a, b), (c, d), (e, f) = rows
        u = [c * f - d * e, b * e - a * f, a * d - b * c]
        size = max(map(abs, u))
        if size > 1e-12:
            return [x / size for x in u]
    m = np.array(rows).T
    return np.linalg.svd(m)[2][-1].tolist()


def _land(prob: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The landing phase: of all roundings of the few open units the one that errs least from the totals."""
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    best, least = None, math.inf
    for bits in range(1 << len(open_)):
        x = prob.copy()
        x[open_] = [(bits >> k) & 1 for k in range(len(open_))]
        off = abs(float(((x - prob) * sizes).sum())) + 1e-6 * abs(float((x - prob).sum()))
        if off < least:
            best, least = x, off
    return prob if best is None else best


def _runs(keys: list[np.ndarray]):
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    cuts = np.flatnonzero(change)
    return zip([0, *cuts], [*cuts, len(keys[0])], strict=True)


def _grouped(function):
    """Calls function(columns) for each run of equal (part, block) of the sorted input, which may span batches."""

    def run(batches):
        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            *whole, (a, z) = list(_runs(cols[:2]))
            for x, y in whole:
                yield function([c[x:y] for c in cols])
            held = [c[a:z] for c in cols]
        if held is not None and len(held[0]):
            yield function(held)

    return run


def _fly(last: bool):
    def work(cols):
        part, _, rank, key, size, prob = cols
        seed = (int(rank[0]) & (2**63 - 1)) ^ len(key)
        out = flight(prob, np.column_stack([size.astype(float), np.ones(len(size))]), seed)
        if last:
            out = _land(out, size.astype(float), seed)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (part, rank, key, size, out)], ["part", "rank", "key", "size", "prob"])

    return _grouped(work)


def balanced(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, chosen) for units (part, rank, key unique, size: longs, prob double): a sample of each part balanced on size and count.

    Units are dealt by a hash into blocks of about ``block``; each flight leaves at most two
    open units, which meet in fewer blocks in the next round, until a part's open units fit one block,
    where the flight ends with the landing.  So no task holds more than a few blocks, whatever a
    part's share of the rows.  Large units fly
    first, so that small ones are left to the landing.  Order and seeds come from ``rank``, a hash of the row's content: reruns agree.
    """
    closed = []
    left = units.where("prob > 0").select("part", "rank", "key", "size", "prob").checkpoint()
    level = 0
    while True:
        counts = left.groupBy("part").agg(F.count("*").alias("n"))
        widest = counts.agg(F.max("n")).first()[0]
        if not widest:
            break
        last = widest <= block
        blocks = F.pmod(F.xxhash64("rank", F.lit(level)), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("long"))
        dealt = left.join(counts, "part").withColumn("block", blocks).select("part", "block", "rank", "key", "size", "prob")
        dealt = dealt.repartition("part", "block").sortWithinPartitions("part", "block", F.desc("size"), "rank", "key")
        flown = dealt.mapInArrow(_fly(last), "part bigint, rank bigint, key bigint, size bigint, prob double").checkpoint()
        closed.append(flown.where("prob <= 0 or prob >= 1").select("key", (F.col("prob") >= 1).alias("chosen")))
        if last:
            break
        left = flown.where("prob > 0 and prob < 1").checkpoint()
        level += 1
    out = units.where("prob <= 0").select("key", F.lit(False).alias("chosen"))
    for c in closed:
        out = out.unionByName(c)
    return out


def _told_apart(sized: DataFrame, block: int) -> DataFrame:
    """sized (checkpointed, with rank and dup) with other ranks for rows that more than ``block`` others equal.

    Equal rows are numbered and take a rank for each ``block`` of them.  They are interchangeable, so it doesn't
    matter which gets which number and reruns agree.  Numbers come from counts by partition; no task sees a whole group.
    """
    many = sized.groupBy("rank").agg(F.count("*").alias("m")).where(F.col("m") > block).select("rank", F.lit(True).alias("many")).checkpoint()
    if many.isEmpty():
        return sized
    rows = sized.join(many, "rank", "left").withColumn("pid", F.shiftright("dup", 33))
    hot = rows.where("many")
    before = F.sum("n").over(Window.partitionBy("rank").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = hot.groupBy("rank", "pid").agg(F.count("*").alias("n")).select("rank", "pid", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("rank", "pid").orderBy("dup")) - 1
    dealt = hot.withColumn("place", place).join(starts, ["rank", "pid"])
    dealt = dealt.withColumn("rank", F.xxhash64("rank", F.floor((F.col("start") + F.col("place")) / F.lit(block))))
    return rows.where("many is null").select(*sized.columns).unionByName(dealt.select(*sized.columns)).checkpoint()


def _taken(sized: DataFrame, weights, share: float, most: float, block: int) -> DataFrame:
    """sized (source, size, rank, dup unique) with source_size, target and taken."""
    found = targets(sized.select("source", "size"), weights, share, most).withColumn("part", F.monotonically_increasing_id()).checkpoint()
    table = found.select(F.col("source").alias("__source"), "source_size", "target", "part")
    if found.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("sure", F.floor(ratio + 1e-9)).withColumn("prob", F.greatest(F.lit(0.0), ratio - F.col("sure")))
    units = rows.where("size > 0").select("part", "rank", F.col("dup").alias("key"), "size", "prob")
    drawn = balanced(units, block).where("chosen").select(F.col("key").alias("dup"), F.lit(1).alias("more"))
    taken = (F.col("size") * (F.col("sure") + F.coalesce("more", F.lit(0)))).cast("long")
    return rows.join(drawn, "dup", "left").withColumn("taken", taken)


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    A document enters floor(target / source_size) times for sure and once more if the balanced sample
    of its source has it, which is drawn with the remaining fraction as its probability.  Null texts and texts
    without words have size 0 and are never drawn; null sources are one source.  Repeated rows and rows
    without an id are units of their own.
    """
    prepare(docs.sparkSession)
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", "source", "text").alias("rank")).withColumn("dup", F.monotonically_increasing_id()).checkpoint()
    return _taken(_told_apart(sized, block), weights, share, most, block).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """The rows of docs with all their columns and size, source_size, target and taken, as in ``mixture``.

    A new column whose name docs has already gets the prefix ``mix_``.  The rows are written to the shared folder once,
    so that each can be told from its equals.
    """
    spark = prepare(docs.sparkSession)
    names, path = [f"c{i}" for i in range(len(docs.columns))], new_folder(spark, "mixed")
    docs.toDF(*names).withColumn("dup", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    of = {c: F.col(n) for n, c in zip(names, docs.columns, strict=True)}
    sized = rows.select("dup", of["doc_id"].alias("doc_id"), of["source"].alias("source"), word_count(names[docs.columns.index("text")]).alias("size"), F.xxhash64(of["doc_id"], of["source"], of["text"]).alias("rank")).checkpoint()
    made = _taken(_told_apart(sized, block), weights, share, most, block).select("dup", "size", "source_size", "target", "taken")
    own = set(docs.columns)

    def free(name):
        while name in own:
            name = f"mix_{name}"
        return name

    return rows.join(made, "dup").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], *[F.col(c).alias(free(c)) for c in made.columns[1:]])
