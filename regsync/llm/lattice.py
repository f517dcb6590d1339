"""How filters overlap: what each removes, by every order in which they can be applied."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_columns, prepare

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that depend on the text (not null) alone: too short, too repetitive, shouting, odd characters."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents fail exactly the filters of the mask's bits (A is bit 0).

    The last filter, E, is failed by a text that a smaller doc_id has too.  Its holder is found by minima that
    are combined before the shuffle, so texts with any number of copies need no task of their own.
    A null text counts as empty, a null source as the empty string.  A null doc_id is neither smaller nor
    larger than another.  A doc_id with several rows in ``labels`` is good or toxic if one of them says so.
    """
    has_columns(docs, "doc_id", "source", "text")
    has_columns(labels, "doc_id", "quality", "toxic")
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(text_filters(text).values())), F.lit(0))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"), mask.alias("mask"))
    rows = rows.groupBy("hash", "doc_id", "part", "mask").agg(F.count("*").alias("n")).join(said, "doc_id", "left")
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), F.col("n")).otherwise(0)
    rows = rows.select("hash", "doc_id", "part", "mask", "n", yes(F.col("good")).alias("good"), yes(F.col("toxic")).alias("toxic")).checkpoint()

    counts = ["n", "good", "toxic"]
    each = F.collect_list(F.struct("part", "mask", *counts)).alias("rows")
    holders = rows.where("doc_id IS NOT NULL").groupBy("hash", "doc_id").agg(each).groupBy("hash").agg(F.min_by("rows", "doc_id").alias("rows"))
    holders = holders.select(F.inline("rows")).unionByName(rows.where("doc_id IS NULL").select("part", "mask", *counts))
    both = rows.select("part", F.col("mask").bitwiseOR(16).alias("mask"), *counts)
    moved = holders.select("part", F.col("mask").bitwiseOR(16).alias("mask"), *(-F.col(c) for c in counts)).toDF("part", "mask", *counts)
    sums = both.unionByName(moved).unionByName(holders).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))
    return sums.where("n > 0").select("part", "mask", F.col("n").alias("docs"), "good", "toxic")


def edges(failed: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """For each part and lattice edge (subset already applied, next filter): what the next filter keeps and removes."""
    n = len(filters)
    all_edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    at = F.array(*(F.struct(F.lit(s).alias("subset"), F.lit(f).alias("f")) for s, f in all_edges))
    rows = failed.select("*", F.explode(at).alias("e")).select("part", "mask", "docs", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, f)")
    alive, fails = F.col("mask").bitwiseAND(F.col("subset")) == 0, F.col("mask").bitwiseAND(bit) != 0
    count = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    return rows.groupBy("part", "subset", "f").agg(
        count(alive & ~fails, "docs", "kept"), count(alive & fails, "docs", "removed"), count(~alive & fails, "docs", "redundant"),
        count(F.col("mask") == bit, "docs", "unique_fails"), count(alive & fails, "good", "good_lost"), count(alive & fails, "toxic", "toxic_lost"),
    )


def orders(edge_counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """The edges along all orders of the filters: one row for each part, order and step, with each filter's removals over all orders."""
    paths = []
    for order in permutations(range(len(filters))):
        subset = 0
        for step, f in enumerate(order, 1):
            paths.append(("".join(filters[i] for i in order), step, subset, f))
            subset |= 1 << f
    steps = edge_counts.sparkSession.createDataFrame(paths, "filter_order string, step int, subset int, f int")
    weights = F.broadcast(steps.groupBy("subset", "f").agg(F.count("*").alias("times")))
    shares = edge_counts.join(weights, ["subset", "f"]).groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return edge_counts.join(F.broadcast(steps), ["subset", "f"]).join(shares, ["part", "f"]).select("part", "filter_order", "step", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source), order of the five filters and step: documents kept, removed, redundant, failing this filter only, good and toxic ones lost, and the filter's removals over all orders.

    Documents are counted once by the set of filters that they fail; the counts go to the 80 edges of the lattice
    of applied subsets, and the edges to the 600 steps of the 120 orders.  An empty table gives no rows.
    """
    return orders(edges(failures(docs, labels)).checkpoint())
