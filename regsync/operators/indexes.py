"""Indexes that are written once and asked often: pages of a sorted table, and texts that contain a string."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import _set_folder


def _new_folder(spark: SparkSession, name: str) -> str:
    _set_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class PageIndex:
    """A table in ranges of its order, one folder each, with how many rows come before each range."""

    spark: SparkSession
    path: str
    order: tuple[str, ...]
    before: tuple[int, ...]
    last: tuple[tuple, ...]
    rows: int
    schema: T.StructType

    def _ranges(self, first: int, stop: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("__range").between(first, stop - 1)).drop("__range")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1): reads and sorts only the ranges that hold it."""
        low = (number - 1) * size
        high = min(low + size, self.rows)
        if low < 0 or low >= high:
            return self._ranges(0, 0)
        first, stop = bisect_right(self.before, low) - 1, bisect_right(self.before, high - 1)
        return self._ranges(first, stop).orderBy(*self.order).offset(low - self.before[first]).limit(size)

    def after(self, key: tuple, size: int) -> DataFrame:
        """The ``size`` rows that follow a key (values of the order columns), from the ranges that hold them."""
        first = next((i for i, last in enumerate(self.last) if _sortable(last) > _sortable(key)), len(self.last))
        held, stop, ends = 0, first, (*self.before, self.rows)
        while stop < len(self.last) and held < size:
            held += ends[stop + 1] - ends[stop] if stop > first else 0  # of the first range any part may come before the key
            stop += 1
        later = reduce(lambda rest, c: _greater(F.col(c[0]), c[1]) | (F.col(c[0]).eqNullSafe(F.lit(c[1])) & rest), list(zip(self.order, key, strict=True))[::-1], F.lit(False))
        return self._ranges(first, stop).where(later).orderBy(*self.order).limit(size)


def _greater(column: Column, value) -> Column:
    return column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))


def _sortable(key: tuple) -> tuple:
    """Nulls come first, as in Spark's order."""
    return tuple((v is not None, v) if v is not None else (False,) for v in key)


#: Ranges of a page index at most; those of larger tables are longer, so what the driver gets doesn't grow with the rows.
RANGES = 1_000


def page_index(df: DataFrame, order: list[str], rows_in_range: int = 100_000, path: str | None = None) -> PageIndex:
    """Sorts the table once into ranges of about ``rows_in_range`` rows, longer ones where that would be more than ``RANGES``; the order should be unique, or pages of equal rows may differ.

    The driver gets two numbers and a key for each range.
    """
    spark = df.sparkSession
    path = path or _new_folder(spark, "pages")
    ranges = max(1, min(RANGES, -(-df.count() // rows_in_range)))
    dealt = df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("__range").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType())])
    ends = spark.read.schema(schema).parquet(path).groupBy("__range").agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last")).orderBy("__range").collect()
    found = {r["__range"]: r for r in ends}
    sizes = [found[i].n if i in found else 0 for i in range(max(found, default=-1) + 1)]
    before = [0, *accumulate(sizes)]
    last = []
    for i in range(len(sizes)):
        last.append(tuple(found[i].last) if i in found else last[-1] if last else (None,) * len(order))
    return PageIndex(spark, path, tuple(order), tuple(before[:-1]), tuple(last), before[-1], schema)


@dataclass(frozen=True)
class TextIndex:
    """Rows and, in buckets, which of them have which three characters in their text."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    kind: str

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def postings(self, grams: list[str]) -> DataFrame:
        """(gram, key) of some grams, from their buckets only."""
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket(F.col("gram"))).distinct()
        numbers = sorted(r[0] for r in wanted.collect())
        return self.spark.read.schema(f"`{self.key}` {self.kind}, gram string, __bucket int").parquet(f"{self.path}/grams").where(F.col("__bucket").isin(numbers) & F.col("gram").isin(grams)).select("gram", self.key)

    def containing(self, query: str) -> DataFrame:
        """The rows whose text contains the query in lower case, exactly: its grams' postings are intersected, the hits verified.

        A query of one or two characters has no gram, so all rows are looked at; an empty one finds all.
        """
        rows = self.spark.read.parquet(f"{self.path}/rows")
        query = query.lower()
        grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
        if grams:
            held = self.postings(grams).groupBy(self.key).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
            rows = rows.join(held.select(self.key), self.key, "left_semi")
        return rows.where(F.contains("__text", F.lit(query))).drop("__text")


#: Rows whose trigrams a task of a text index sorts on average, and rows of a part of a bucket; both grow in number with the table, not in size.
TASK_ROWS, PART_ROWS = 5_000, 50_000


def text_index(df: DataFrame, key: str, text: Column, buckets: int = 64, path: str | None = None) -> TextIndex:
    """Indexes the rows by the distinct trigrams of ``text`` in lower case; ``key`` must be unique and not null.

    A gram that most rows have is spread by the rows' keys while it is written; a null text counts as empty.
    """
    spark = df.sparkSession
    path = path or _new_folder(spark, "grams")
    out = TextIndex(spark, path, key, buckets, dict(df.dtypes)[key])
    df.withColumn("__text", F.lower(F.coalesce(text, F.lit("")))).write.mode("overwrite").parquet(f"{path}/rows")
    own = spark.read.parquet(f"{path}/rows")
    # characters in an array, as taking the i-th one of a text takes time with i
    chars = own.where(F.length("__text") >= 3).select(key, F.regexp_extract_all("__text", F.lit("(?s)."), F.lit(0)).alias("c"))
    gram = F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))
    grams = chars.select(key, F.explode(F.array_distinct(gram)).alias("gram"))
    grams = grams.withColumn("__bucket", out._bucket(F.col("gram")))
    n = own.count()
    grams.repartition(max(8, n // TASK_ROWS), "__bucket", F.pmod(F.xxhash64(key), F.lit(max(8, n // PART_ROWS)))).sortWithinPartitions("__bucket", "gram").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/grams")
    return out
