"""Connected components of a graph given by its links."""

from __future__ import annotations

import re
import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _set_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="regsync-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that ``spark.checkpoint.dir`` names; where it is unset and Spark is local (tests), in a temporary one."""
    _set_folder(df.sparkSession)
    return df.checkpoint()


def cut_all(*frames: DataFrame) -> list[DataFrame]:
    """``cut`` for tables that don't depend on each other, whose jobs are planned and run at the same time."""
    _set_folder(frames[0].sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(cut), df) for df in frames]]


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows to all cores where the input has fewer partitions than cores; larger inputs stay as they are.

    Folding and parsing a row costs far more than moving it.  For scans and checkpoints, whose partitions are known without a job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node that is not its component's smallest, that smallest.

    Alternates large-star and small-star steps until the links are stars.  A step is a minimum by node,
    combined before the shuffle, and a join that adaptive execution can split, so a hub needs no task of its own.
    """
    links = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = state(links)
    while now[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, state(links)
        if now == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
