"""Maintenance of a registry: unique ids, sanitised addresses, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import PARTS, with_parsed_address
from ..functions.base import first_filled
from .components import cut


def duplicate_ids(df: DataFrame, top: int = 50) -> DataFrame:
    """(id, total) of the ids that more than one row has, the most frequent first."""
    return df.groupBy("id").agg(F.count("*").alias("total")).where("total > 1").orderBy(F.desc("total"), "id").limit(top)


def duplicate_preview(df: DataFrame, top: int = 20) -> DataFrame:
    """(id, total, exemplo) of the most repeated ids."""
    return df.groupBy("id").agg(F.count("*").alias("total"), F.min("nome_instituicao").alias("exemplo")).where("total > 1").orderBy(F.desc("total"), "id").limit(top)


def excess_rows(df: DataFrame) -> DataFrame:
    """One row: how many ids are repeated, how many rows are too many, and whether the ids are unique."""
    counts = df.groupBy("id").agg(F.count("*").alias("total")).where("total > 1")
    out = counts.agg(F.count("*").alias("ids_duplicados"), F.coalesce(F.sum(F.col("total") - 1), F.lit(0)).cast("long").alias("excesso"))
    return out.withColumn("unico", F.col("ids_duplicados") == 0)


def dedupe_ids(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the first row of each id, and all others for a side table, equal rows among them."""
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    first = rows.groupBy("id").agg(F.min(F.struct(*order, "__row")).alias("__f")).select(F.col("__f.__row").alias("__row"))
    kept = rows.join(first, "__row", "left_semi").select(*df.columns)
    return kept, rows.join(first, "__row", "left_anti").select(*df.columns)


def sanitized(df: DataFrame) -> DataFrame:
    """Registry rows whose municipality, state or code change when the address is parsed again; parsed values win.

    df: id, endereco, municipio, uf, cep.  Returns id and the new values (novo_municipio, novo_uf, novo_cep) with the parts.
    """
    c = F.col
    text = {n: F.coalesce(n, F.lit("")) for n in ("municipio", "uf", "cep")}
    out = with_parsed_address(df, "p", c("endereco"), c("municipio"), c("uf"))
    new = {n: first_filled(c(f"p.{n}"), text[n]) for n in text}
    out = out.select("id", *[text[n].alias(n) for n in text], *[v.alias(f"novo_{n}") for n, v in new.items()], *[c(f"p.{x}").alias(x) for x in PARTS if x not in text])
    dirty = F.contains("municipio", F.lit(" - ")) | c("municipio").rlike(" (RJ|SP|MG) ")
    out = cut(out)  # else the filter's columns would be expanded down through all of the parsing's steps
    return out.where((c("novo_municipio") != c("municipio")) | dirty | (c("novo_uf") != c("uf")) | (c("novo_cep") != c("cep")))


def with_sanitized(df: DataFrame, changed: DataFrame, now=None) -> DataFrame:
    """The registry with the values that ``sanitized`` found in place of the old ones; filled parts replace old ones."""
    new = changed.select("id", *[F.col(f"novo_{n}").alias(f"__{n}") for n in ("municipio", "uf", "cep")], *[F.col(x).alias(f"__{x}") for x in ("logradouro", "numero", "complemento", "bairro")], F.lit(True).alias("__new")).dropDuplicates(["id"])
    value = lambda n: F.when(F.col("__new"), first_filled(F.col(f"__{n}"), F.col(n))).otherwise(F.col(n)).alias(n)
    stamp = F.current_timestamp() if now is None else now
    cols = [value(n) if n in PARTS else F.when(F.col("__new"), stamp).otherwise(F.col(n)).alias(n) if n == "atualizado_em" else F.col(n) for n in df.columns]
    return df.join(new, "id", "left").select(*cols)


def active_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of active rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.where("ativo = 1").agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def latest(df: DataFrame, order: str = "id") -> DataFrame:
    """The row with the largest ``order``."""
    return df.orderBy(F.desc(order)).limit(1)


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """(nome, presente): whether some row's folded name holds each given one."""
    from ..functions.base import fold

    flags = df.select(fold(F.col("nome_instituicao")).alias("f")).agg(*[F.coalesce(F.max(F.contains("f", fold(F.lit(n)))), F.lit(False)).alias(f"n{i}") for i, n in enumerate(names)])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(n).alias("nome"), F.col(f"n{i}").alias("presente")) for i, n in enumerate(names)])).alias("x")).select("x.*")
