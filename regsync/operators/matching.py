"""One-to-one matching of batch rows to registry rows through prioritised keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import TIERS
from .components import connected_components, cut, cut_all

_KEYS = [k for k, _ in TIERS]


def tier_candidates(batch: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """(csv_ord, db_ord) of all pairs with an equal key."""
    own = batch.select(F.col("ord").alias("csv_ord"), key).where(F.col(key).isNotNull())
    return own.join(registry.select(F.col("ord").alias("db_ord"), key).where(F.col(key).isNotNull()), key).select("csv_ord", "db_ord")


def tier_match(batch: DataFrame, registry: DataFrame, key: str, policy: str = "first") -> DataFrame:
    """(csv_ord, db_ord) by one tier alone: the first registry row of the key's bucket, or its sole one."""
    heads = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("db_ord"), F.count("*").alias("n"))
    if policy == "sole":
        heads = heads.where("n = 1")
    return batch.select(F.col("ord").alias("csv_ord"), key).join(heads, key).select("csv_ord", "db_ord")


def greedy(batch: pd.DataFrame, registry: pd.DataFrame) -> pd.DataFrame:
    """Each batch row in order tries all tiers before the next row starts, and takes up its registry row.

    A row that finds nothing free falls back, in tier 8, on the first row of its bucket even if that is taken.
    Buckets know how many of their rows are free and where the first may be, so the time grows with the rows.
    A key that is null or 0 is none.
    """
    columns = lambda df: [df.sort_values("ord")[c].tolist() for c in ("ord", *_KEYS)]
    buckets: dict[tuple, list] = {}  # rows, place of the first that may be free, how many are free
    held: dict[int, list] = {}  # a registry row's buckets
    for ord_, *values in zip(*columns(registry), strict=True):
        held[ord_] = own = []
        for k, value in zip(_KEYS, values, strict=True):
            if value and value == value:
                bucket = buckets.setdefault((k, value), [[], 0, 0])
                bucket[0].append(ord_)
                bucket[2] += 1
                own.append(bucket)
    taken: set[int] = set()
    out = []
    for ord_, *values in zip(*columns(batch), strict=True):
        own = [buckets.get((k, v)) if v and v == v else None for k, v in zip(_KEYS, values, strict=True)]
        found, tier = None, None
        for number, (bucket, (_, policy)) in enumerate(zip(own, TIERS, strict=True), 1):
            if bucket and bucket[2] and (policy == "first" or bucket[2] == 1):
                while bucket[0][bucket[1]] in taken:
                    bucket[1] += 1
                found, tier = bucket[0][bucket[1]], number
                break
        if found is not None:
            taken.add(found)
            for bucket in held[found]:
                bucket[2] -= 1
        else:  # the third bucket counts only where the first has no such key and the second can't be asked
            last = own[0] or (own[1] if values[1] and values[1] == values[1] else own[4])
            if last:
                found, tier = last[0][0], 8
        if found is not None:
            out.append((ord_, found, tier))
    return pd.DataFrame(out, columns=["csv_ord", "db_ord", "tier"]).astype("int64")


#: Rows of both sides that one Python group may hold: all of them, or one connected component.
SMALL = 50_000
#: Rows of both sides that a group of several components holds on average.
GROUP = 20_000
#: How often a round passes on doubt before it leaves the rows concerned to the next round.
PASSES = 3


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df with the row's number among those of equal keys, by ``order`` (unique there); a key's rows are spread over ranges of the order, so none needs one task."""
    from pyspark.sql import Window

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(parts, *keys, order).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(order))
    return dealt.withColumn("__own", own).join(sums, ["__part", *keys]).withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def _least_touching(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(tier, key, least): for each bucket the least of ``rows`` (ord, tier, key) that shares any key with one of the bucket's registry rows."""
    by_key = rows.groupBy("tier", "key").agg(F.min("ord").alias("least"))
    by_row = registry.join(by_key, ["tier", "key"]).groupBy("ord").agg(F.min("least").alias("least"))
    return registry.join(by_row, "ord").groupBy("tier", "key").agg(F.min("least").alias("least"))


def _least_taking(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """(tier, key, least): for each bucket the least row that is paired, from another bucket, with one of the bucket's registry rows."""
    own = pairs.select(F.col("db_ord").alias("ord"), F.col("ord").alias("least"), F.col("tier").alias("t"), F.col("key").alias("k"))
    return registry.join(own, "ord").where("tier <> t or key <> k").groupBy("tier", "key").agg(F.min("least").alias("least"))


def rounds(batch: DataFrame, registry: DataFrame, small: int = SMALL) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Matches in rounds what can be matched for certain: (pairs csv_ord, db_ord, tier or None, open batch links, free registry links).

    batch and registry are links (ord, tier, key).  In each round a batch row stands at the first tier that has a
    free candidate for it (a sole one where the tier asks for that).  Rows of one bucket are paired with its free rows by
    their numbers.  A pairing is certain if no earlier row may interfere: neither one that is paired from another
    bucket with a row of this one, nor one that is in doubt itself (because it has no candidate for its number, or a
    tier before might still become sole) and shares a key with a row of the bucket; what such rows reach is in doubt too.
    A row that is the least of all open rows that reach its candidates is certain in any case, so each round settles a
    row at least.  Ends when the open rows of both sides are ``small``.
    """
    sole = F.col("tier").isin(*[i for i, (_, policy) in enumerate(TIERS, 1) if policy == "sole"])
    pairs = None
    while True:
        free = registry.groupBy("tier", "key").agg(F.count("*").alias("n"))
        batch = cut(batch.join(free, ["tier", "key"]))  # a bucket without free rows stays so
        here = registry.join(batch.select("tier", "key").distinct(), ["tier", "key"])
        registry = cut(registry.join(here.select("ord").distinct(), "ord", "left_semi"))
        if batch.select("ord").distinct().count() + registry.select("ord").distinct().count() <= small:
            return pairs, batch.drop("n"), registry
        fits = ~sole | (F.col("n") == 1)
        stand = batch.groupBy("ord").agg(F.min(F.when(fits, F.struct("tier", "key", "n"))).alias("at"), F.min(F.when(~fits, F.col("tier"))).alias("later"))
        stand = stand.select("ord", "at.*", "later")
        ranked = numbered(stand.where("tier is not null"), ["tier", "key"], "ord", "i")
        certain = (F.col("later").isNull() | (F.col("later") > F.col("tier"))) & (F.col("i") <= F.col("n"))
        ranked = cut(ranked.withColumn("sure", certain))
        stands = ranked.select("tier", "key").distinct()
        theirs = cut(numbered(registry.join(stands, ["tier", "key"], "left_semi"), ["tier", "key"], "ord", "i").withColumnRenamed("ord", "db_ord"))
        doubt = cut(stand.where("tier is null").select("ord").unionByName(ranked.where("not sure").select("ord")))
        sure, border = cut(ranked.where("sure").join(theirs, ["tier", "key", "i"]).select("ord", "tier", "key", "db_ord")), None
        for _ in range(PASSES):
            least = _least_touching(batch.join(doubt, "ord", "left_semi"), registry).unionByName(_least_taking(sure, registry)).groupBy("tier", "key").agg(F.min("least").alias("least"))
            held = cut(sure.join(least, ["tier", "key"], "left").withColumn("hit", F.coalesce(F.col("least") < F.col("ord"), F.lit(False))).drop("least"))
            fell = held.where("hit").select("ord")
            border = fell.agg(F.min("ord")).first()[0]
            sure = held.where("not hit").drop("hit")
            if border is None:
                break
            doubt = cut(doubt.unionByName(fell))
        if border is not None:  # doubt spreads to later rows only
            sure = sure.where(F.col("ord") < border)
        reach = batch.join(_least_touching(batch, registry), ["tier", "key"]).groupBy("ord").agg(F.min("least").alias("least")).where("least = ord")
        first = stand.join(reach.select("ord"), "ord")
        heads = theirs.where("i = 1").drop("i")
        made = sure.unionByName(first.where("tier is not null").join(heads, ["tier", "key"]).select("ord", "tier", "key", "db_ord")).distinct()
        made = cut(made.select(F.col("ord").alias("csv_ord"), "db_ord", F.col("tier").cast("long").alias("tier")))
        pairs = made if pairs is None else pairs.unionByName(made)
        done = made.select(F.col("csv_ord").alias("ord")).unionByName(first.where("tier is null").select("ord"))
        batch = batch.drop("n").join(done, "ord", "left_anti")
        registry = registry.join(made.select(F.col("db_ord").alias("ord")), "ord", "left_anti")


def _rows(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """(side, ord, k1 ... k7) of the rows that share a key with the other side: hashes of the keys that both sides have, else 0.

    A batch row's second key that the registry lacks is 1, as the fallback asks whether there is one.
    """
    tiers = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("tier"), F.xxhash64(F.lit(k), k).alias("key"))) for i, k in enumerate(_KEYS, 1)])
    side = lambda df, s: df.select(F.lit(s).alias("side"), "ord", (F.lit(s == "b") & F.col("k2").isNotNull()).alias("two"), F.explode(tiers).alias("t")).where("t is not null").select("side", "ord", "two", "t.*")
    links = side(batch, "b").unionByName(side(registry, "r"))
    shared = links.groupBy("key").agg(F.max(F.col("side") == "b").alias("b"), F.max(F.col("side") == "r").alias("r")).where("b and r")
    keys = [F.max(F.when(F.col("tier") == i, F.col("key"))).alias(k) for i, k in enumerate(_KEYS, 1)]
    rows = links.join(shared, "key", "left_semi").groupBy("side", "ord", "two").agg(*keys)
    return rows.withColumn("k2", F.coalesce("k2", F.col("two").cast("long"))).drop("two").fillna(0)


def _links(rows: DataFrame) -> DataFrame:
    """(ord, tier, key) of ``_rows``."""
    return rows.select("ord", F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("tier"), F.col(k).alias("key")) for i, k in enumerate(_KEYS, 1)]), lambda t: ~t["key"].isin(0, 1))).alias("t")).select("ord", "t.*")


def _rooted(rows: DataFrame) -> DataFrame:
    """``_rows`` with the root of the component that each belongs to, all of whose keys are in it."""
    held = F.filter(F.array(*_KEYS), lambda k: ~k.isin(0, 1))
    first = rows.withColumn("first", F.array_min(held))
    links = first.select("first", F.explode(held).alias("key")).where("key <> first").distinct()
    roots = connected_components(links, "first", "key")
    return first.join(roots.withColumnRenamed("node", "first"), "first", "left").withColumn("root", F.coalesce("root", "first")).drop("first")


def match(batch: DataFrame, registry: DataFrame, small: int = SMALL) -> DataFrame:
    """(csv_ord, db_ord, tier) for the batch rows that match; both sides with keys.

    The result of the sequential procedure (``greedy``).  Rows can interfere only where keys connect them, so
    the procedure runs in each connected component by itself, several components to a Python group.  A component of more
    than ``small`` rows is matched in rounds of joins until so much of it is left, and that goes to one group.
    So no group or task grows with the input or with a key's rows.
    """
    rows = cut(_rows(batch, registry))
    n = rows.count()
    if n <= small:
        return _in_groups(rows, 1)
    rows = cut(_rooted(rows))
    large = cut(rows.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > small).select("root"))
    groups = -(-n // GROUP)
    if large.isEmpty():
        return _in_groups(rows, groups)
    few, rows = cut_all(*[rows.join(large, "root", kind) for kind in ("left_anti", "left_semi")])
    pairs = _in_groups(few, groups)
    own, theirs = (rows.where(F.col("side") == s).select("ord", *[F.nullif(F.col(k), F.lit(0)).alias(k) for k in _KEYS]) for s in "br")
    sure, open_, free = rounds(*[_links(rows.where(F.col("side") == s)) for s in "br"], small)
    left = rows.where("side = 'b'").join(open_.select("ord").distinct(), "ord", "left_semi").unionByName(rows.where("side = 'r'").join(free.select("ord").distinct(), "ord", "left_semi"))
    found = _in_groups(cut(left), 1).where("tier < 8")
    found = cut(found if sure is None else sure.unionByName(found))
    unmatched = own.join(found.select(F.col("csv_ord").alias("ord")), "ord", "left_anti")
    return pairs.unionByName(found).unionByName(fallback(unmatched, theirs).withColumn("tier", F.lit(8).cast("long")))


def _in_groups(rows: DataFrame, groups: int) -> DataFrame:
    """``greedy`` over ``_rows``, whose components are dealt to groups."""
    group = F.pmod(F.xxhash64("root"), F.lit(groups)) if groups > 1 else F.lit(0)
    side = lambda s: rows.where(F.col("side") == s).select("ord", *_KEYS, group.alias("group")).groupBy("group")
    work = lambda x, y: greedy(x, y)
    return side("b").cogroup(side("r")).applyInPandas(work, "csv_ord bigint, db_ord bigint, tier bigint")


def cascade(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """(csv_ord, db_ord, tier): a faster form that finishes a tier for all rows before the next.

    Pairs the rows of a bucket in order.  Equal to ``match`` where keys are unique, else it may differ.
    """
    from pyspark.sql import Window

    own, theirs, out = batch.select("ord", *_KEYS), registry.select("ord", *_KEYS), None
    for number, (k, policy) in enumerate(TIERS, 1):
        rank = lambda df, k=k: df.where(F.col(k).isNotNull()).select("ord", k, F.row_number().over(Window.partitionBy(k).orderBy("ord")).alias("i"), F.count("*").over(Window.partitionBy(k)).alias("n"))
        x, y = rank(own), rank(theirs)
        if policy == "sole":
            y = y.where("n = 1")
        pairs = x.alias("x").join(y.alias("y"), (F.col(f"x.{k}") == F.col(f"y.{k}")) & (F.col("x.i") == F.col("y.i")))
        pairs = cut(pairs.select(F.col("x.ord").alias("csv_ord"), F.col("y.ord").alias("db_ord"), F.lit(number).cast("long").alias("tier")))
        out = pairs if out is None else out.unionByName(pairs)
        own = own.join(pairs.select(F.col("csv_ord").alias("ord")), "ord", "left_anti")
        theirs = theirs.join(pairs.select(F.col("db_ord").alias("ord")), "ord", "left_anti")
    return out


def fallback(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """(csv_ord, db_ord): the first row of the bucket that the last tier looks into, taken or not."""
    heads = {k: registry.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("ord").alias(f"h_{k}")) for k in ("k1", "k2", "k5")}
    df = batch.select("ord", "k1", "k2", "k5")
    for k, h in heads.items():
        df = df.join(h, k, "left")
    found = F.coalesce("h_k1", F.when(F.col("k2").isNotNull(), F.col("h_k2")).otherwise(F.col("h_k5")))
    return df.select(F.col("ord").alias("csv_ord"), found.alias("db_ord")).where("db_ord is not null")


def lookup(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(ord, step, db_ord) for a list of names: by natural key, by core name with municipality and state, by the first 12 folded characters, all of a shorter name."""
    from ..functions.base import fold

    out = names
    for step, k in enumerate(("k1", "k2"), 1):
        head = registry.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("ord").alias(f"d{step}"))
        out = out.join(head, k, "left")
    start = lambda df: F.substring(fold(df["nome"]), 1, 12)
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(F.col("s"), F.lit(1), i)))
    head = registry.select("ord", start(registry).alias("s")).where("s <> ''").select("ord", begins.alias("start12")).groupBy("start12").agg(F.min("ord").alias("d3"))
    out = out.withColumn("start12", start(out)).join(head, "start12", "left")
    found = F.coalesce("d1", "d2", "d3")
    step = F.when(F.col("d1").isNotNull(), 1).when(F.col("d2").isNotNull(), 2).when(F.col("d3").isNotNull(), 3)
    return out.select("ord", step.alias("step"), found.alias("db_ord"))
