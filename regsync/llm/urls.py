"""URL filters: rules, and for other URLs a path-template tree of each host judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: (verdict, rule): host and path start of the rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of the tree; what lies deeper is one further segment.  Distinct children of a branch, and their share of its URLs, from which they are one variable segment.
LEVELS, CHILDREN, VARIETY = 8, 20, 0.5
#: Branches are alike if their next segments with a share of 1/HEAVY or more are the same with the same shares, rounded to 1/STEPS.
HEAVY, STEPS = 8, 4
#: Smoothed purity: a template's labels are weighed against STRENGTH labels of its parent's share of bad ones, the host's against
#: all hosts', those against PRIOR.
PRIOR, STRENGTH, REJECT = 0.2, 10.0, 0.5
#: Templates up to which their table is broadcast.
BROADCAST_TEMPLATES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for a null or one without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments with numbers, long hexadecimal and mixed identifiers generalised; at most LEVELS + 1."""
    cut = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+", LEVELS + 1)
    typed = F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "<id>"), r"\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}\b", "<id>"), r"[0-9]+", "<n>"))
    return F.when(F.length(F.regexp_replace(path, "/", "")) == 0, F.array(F.lit(""))).otherwise(typed)


def template_tree(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, segs, n, labelled, bad) with the column template.

    Goes down level by level.  Children of a branch become one variable segment ``*`` if they are many and mostly
    seen once.  Else those whose next segments are distributed alike and whose labels fall on the same side merge into one
    segment, written as the least of their names with ``~``.  Children are compared by a signature of at most ``HEAVY``
    next segments, never with each other.
    """
    now = shapes.withColumn("template", F.lit(""))
    deepest = shapes.agg(F.max(F.size("segs"))).first()[0] or 0
    keys = ["host", "template"]
    for level in range(deepest):
        rows = now.withColumns({"seg": F.get("segs", F.lit(level)), "next": F.coalesce(F.get("segs", F.lit(level + 1)), F.lit("/"))})
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        detail = rows.where("seg is not null").groupBy(*keys, "seg", "next").agg(*sums).checkpoint()
        child = detail.groupBy(*keys, "seg").agg(*sums)
        branch = child.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.count("*").alias("children"))
        share = F.col("n") / F.col("own_n")
        heavy = detail.join(child.select(*keys, "seg", F.col("n").alias("own_n")), [*keys, "seg"]).where(share >= 1 / HEAVY)
        shares = heavy.groupBy(*keys, "seg").agg(F.array_sort(F.collect_list(F.struct("next", F.round(share * STEPS).cast("int").alias("share")))).alias("shares"))
        tested = child.join(branch, keys).join(shares, [*keys, "seg"], "left")
        # a struct of what a family shares: null-safe as a grouping and joining key
        alike = F.struct(F.coalesce("shares", F.array()).alias("shares"), (smoothed(F.col("labelled"), F.col("bad"), F.lit(PRIOR)) >= REJECT).alias("side"))
        tested = tested.withColumns({"alike": alike, "many": (F.col("children") >= CHILDREN) & (F.col("children") >= VARIETY * F.col("all_n"))})
        family = tested.where("not many").groupBy(*keys, "alike").agg(F.min("seg").alias("least"), F.count("*").alias("members"))
        out = F.when(F.col("many"), "*").when(F.col("members") > 1, F.concat("least", F.lit("~"))).otherwise(F.col("seg"))
        merged = tested.join(family, [*keys, "alike"], "left").select(*keys, "seg", out.alias("out")).checkpoint()
        small = merged.count() <= BROADCAST_TEMPLATES
        step = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "out"))
        now = rows.join(F.broadcast(merged) if small else merged, [*keys, "seg"], "left").withColumn("template", step).select(*now.columns)
        if not small:
            now = now.checkpoint()
    return now


def smoothed(labelled: Column, bad: Column, expected: Column) -> Column:
    """The share of bad labels, drawn towards the expected share."""
    return (bad + STRENGTH * expected) / (labelled + STRENGTH)


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity) from rows (host, template, labelled, bad): each template's share of bad labels against its parent's, down from all hosts'.

    A template without labels takes its parent's share, and a few labels of a large template change it little.
    """
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    depth = F.explode(F.sequence(F.lit(1), F.size(F.split("template", "/")))).alias("depth")
    above = F.array_join(F.slice(F.split("template", "/"), F.lit(1), F.col("depth")), "/")
    templates = tree.groupBy("host", "template").agg(*sums)
    paths = templates.select("host", "template", "labelled", "bad", depth).withColumn("above", above)
    own = paths.groupBy("host", "above").agg(*sums)  # of depth 1 the empty one: the host
    chain = F.array_sort(F.collect_list(F.struct("depth", "labelled", "bad")))
    chains = paths.select("host", "template", "above", "depth").join(own, ["host", "above"]).groupBy("host", "template").agg(chain.alias("chain"))
    whole = templates.agg(smoothed(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.lit(PRIOR)).alias("whole"))
    purity = F.aggregate("chain", F.col("whole"), lambda up, own: smoothed(own["labelled"], own["bad"], up))
    return chains.join(F.broadcast(whole)).select("host", "template", purity.alias("purity"))  # one row


def page_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (page_id, url, body_hash) with ``bad``: whether the document that the page shows is labelled as poor or toxic, null without a label.

    labels: doc_id, quality, toxic.  A page shows a document if its article's text without headings is the document's, white
    space aside.  Copies of a text share their labels; one bad label of any decides.
    """
    text = F.btrim(F.regexp_replace("text", r"(?U)\s+", " "))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))).alias("bad")).where("bad is not null")
    shown = docs.select("doc_id", F.xxhash64(text).alias("body_hash")).join(marks, "doc_id").groupBy("body_hash").agg((F.max("bad") == 1).alias("bad"))
    return pages.join(shown, "body_hash", "left").select("page_id", "url", "bad")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """For each row of pages (page_id, url and, if it is there, bad): page_id, host, path, rule, verdict, template and purity.

    Labels are the column ``bad`` of single pages (boolean, null if there is none; see ``page_labels``) and, for URLs that
    a rule fits, the rule's verdict.  A URL without a rule is blocked if its template's smoothed share of bad labels
    (see ``purities``) is ``REJECT`` or more.  Null URLs and those without ``://`` have empty host and path and are judged like others.
    """
    prepare(pages.sparkSession)
    host, path = parts()
    own = F.col("bad") if "bad" in pages.columns else F.lit(None).cast("boolean")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), own.alias("own"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said, "segs": segments(F.col("path"))}).withColumn("shape", F.array_join("segs", "/"))
    label = F.coalesce(F.col("said") == "block", F.col("own"))
    shapes = rows.groupBy("host", "shape").agg(F.first("segs").alias("segs"), F.count("*").alias("n"), F.sum(label.isNotNull().cast("long")).alias("labelled"), F.sum(F.coalesce(label, F.lit(False)).cast("long")).alias("bad")).checkpoint()
    tree = template_tree(shapes).checkpoint()
    table = tree.select("host", "shape", "template").join(purities(tree), ["host", "template"]).select("host", "shape", "template", "purity").checkpoint()
    if table.count() <= BROADCAST_TEMPLATES:
        table = F.broadcast(table)
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.join(table, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
