"""Searches over registry and batch rows, samples and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import filled


def matches(query: str, *columns: str) -> Column:
    """Whether the row's filled columns, lower-cased and joined by spaces, contain the query."""
    text = F.lower(F.concat_ws(" ", *[filled(F.col(c)) for c in columns]))
    return F.contains(text, F.lower(F.lit(query)))


def search(registry: DataFrame, batch: DataFrame, query: str, columns: list[str], scope: str = "ambos", filters: dict[str, str] | None = None) -> DataFrame:
    """Rows of the scope (banco, raspagem, ambos) that contain the query, and each filter's text in its column; ``origem`` says whence."""
    sides = [(n, d) for n, d in (("banco", registry), ("raspagem", batch)) if scope in ("ambos", n)]
    out = None
    for name, df in sides:
        own = df.select(*columns).where(matches(query, *columns) if query else F.lit(True)).withColumn("origem", F.lit(name))
        out = own if out is None else out.unionByName(own)
    for column, text in (filters or {}).items():
        out = out.where(F.contains(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lower(F.lit(text))))
    return out


def page(df: DataFrame, order: list, number: int, size: int = 15) -> DataFrame:
    """Page ``number`` (from 1) of the rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
