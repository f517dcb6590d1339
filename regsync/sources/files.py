"""Delimited files, versioned outputs and the newest of several files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"sep": ";", "header": "true", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A semicolon file with header, quoted and multi-line fields; empty fields are null."""
    reader = spark.read.options(**OPTIONS)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Writes a semicolon file with header; nulls are empty.  single: one part file, for small reports."""
    texts = df.select(*[F.to_json(c).alias(c) if isinstance(f.dataType, T.ArrayType | T.StructType) else F.col(c) for c, f in zip(df.columns, df.schema.fields, strict=True)])
    (texts.coalesce(1) if single else texts).write.mode("overwrite").options(**(OPTIONS | {"emptyValue": "", "nullValue": ""})).csv(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Pairs (inst_snowflake_id, course_snowflake_id); a missing file has none."""
    schema = "inst_snowflake_id LONG, course_snowflake_id LONG"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema).dropna()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def newest(spark: SparkSession, candidates: list[str]) -> str | None:
    """The existing candidate that was changed last; the earlier one of equals."""
    found = []
    for i, path in enumerate(candidates):
        p, fs = _fs(spark, path)
        if fs.exists(p):
            found.append((fs.getFileStatus(p).getModificationTime(), -i, path))
    return max(found)[2] if found else None


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((p for p in candidates if exists(spark, p)), None)


def write_versioned(df: DataFrame, folder: str, stamp: datetime | None = None) -> str:
    """Writes ts=<yyyyMMdd_HHmmss>/ and overwrites latest/; returns the versioned path."""
    path = f"{folder}/ts={(stamp or datetime.now()):%Y%m%d_%H%M%S}"
    write_csv(df, path)
    write_csv(read_csv(df.sparkSession, path), f"{folder}/latest")
    return path


def rows_or_newest(rows: DataFrame | None, spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The rows that came with a request, else those of the newest file."""
    if rows is not None and not rows.isEmpty():
        return rows
    path = newest(spark, candidates)
    if path is None:
        raise FileNotFoundError("no rows were given and no file is there")
    return read_csv(spark, path)


def rows_from_json(spark: SparkSession, records: list[dict], schema: T.StructType | str) -> DataFrame:
    """Rows of a request's body."""
    return spark.createDataFrame([tuple(r.get(f) for f in spark.createDataFrame([], schema).columns) for r in records], schema)
