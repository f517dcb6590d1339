"""Scans with the rules of a scanner that reads byte after byte: no quotes, fields of limited length, an end at the first bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists

#: Bytes of a line that are read at once, and of each text field at most.
LINE = 8191
FIELDS = (("nome_instituicao", 255), ("dependencia_adm", 63), ("endereco", 511), ("telefone", 63), ("email", 127), ("homepage", 255))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value) of a text file or a folder of them: file, start of the split and place in it give the order of the lines, so splits are read in parallel."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.select("file", "block", F.monotonically_increasing_id().alias("place"), "value")


def _numbered(lines: DataFrame, header: bool) -> DataFrame:
    """(at, value): the order as one column, without the first line of all if that is the header."""
    rows = lines.select(F.struct("file", "block", "place").alias("at"), "value")
    if not header:
        return rows
    first = rows.agg(F.min("at").alias("first"))
    return rows.join(F.broadcast(first)).where("at > first").select("at", "value")  # one row


def until(rows: DataFrame, stop: Column, keep: Column) -> DataFrame:
    """The rows (with ``at``) before the first one where ``stop`` holds, and that one if ``keep`` does; the least place is found by all tasks together."""
    least = rows.where(stop).agg(F.min("at").alias("end"))
    return rows.join(F.broadcast(least)).where(F.col("end").isNull() | (F.col("at") < F.col("end")) | ((F.col("at") == F.col("end")) & keep)).drop("end")  # one row


def scan_relations(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Pairs (inst_snowflake_id, course_snowflake_id) of whole numbers up to the first malformed line, in no order; a missing file has none.

    A line that goes on after its pair gives the pair and ends the scan; blank lines are passed over.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "inst_snowflake_id LONG, course_snowflake_id LONG")
    pair = r"^\s*(\d+);\s*(\d+)"
    number = lambda i: F.regexp_extract("value", pair, i).try_cast("long")
    rows = _numbered(ordered_lines(spark, path), header).where(F.col("value").rlike(r"\S"))
    rows = rows.select("at", number(1).alias("inst_snowflake_id"), number(2).alias("course_snowflake_id"), F.col("value").rlike(pair + r"\s*$").alias("whole"))
    good = F.col("inst_snowflake_id").isNotNull() & F.col("course_snowflake_id").isNotNull()
    return until(rows, ~(F.col("whole") & good), good).select("inst_snowflake_id", "course_snowflake_id")


def scan_institutions(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """snowflake_id and six text fields of semicolon lines without quotes.

    A field ends at a semicolon or at its length in bytes; the first that is empty or too long ends its line, and the
    fields after it are empty.  A line that doesn't begin with a number is passed over.  Of lines longer than ``LINE``
    bytes each stretch of so many counts as a line.  A character that a length cuts becomes a replacement character.
    """
    inner = ""
    for i, (_, most) in reversed(list(enumerate(FIELDS))):
        kind = "[^\\n]" if i == len(FIELDS) - 1 else "[^;]"
        inner = f"(?:;({kind}{{1,{most}}}){inner})?"
    pattern = rf"(?s)^\s*(\d+){inner}"
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")  # one character for each byte
    rows = _numbered(ordered_lines(spark, path), False).select("at", raw.alias("raw"))
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("raw") - 1, F.lit(0)) / LINE)), lambda k: F.substring(F.col("raw"), (k * LINE + 1).cast("int"), F.lit(LINE)))).alias("nth", "piece")
    rows = rows.select("at", pieces)
    if header:  # the first stretch of the first line
        first = rows.agg(F.min(F.struct("at", "nth")).alias("first"))
        rows = rows.join(F.broadcast(first)).where(F.struct("at", "nth") > F.col("first"))  # one row
    text = lambda i: F.make_valid_utf8(F.encode(F.regexp_extract("piece", pattern, i), "ISO-8859-1").cast("string"))
    own = F.regexp_extract("piece", pattern, 1).try_cast("long")
    return rows.select(own.alias("snowflake_id"), *[text(i).alias(name) for i, (name, _) in enumerate(FIELDS, 2)]).where("snowflake_id is not null")
