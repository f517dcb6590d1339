"""Offers gathered for each institution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import PARTS, with_parsed_address
from ..functions.base import filled, first_filled


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    A minimum over structs, combined before the shuffle, so a key with very many rows needs no window.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("__r")
    return df.groupBy(*keys).agg(least).select(*[c if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def institution_ids(rows: DataFrame, keys: tuple[str, ...] = ("nome",), order: tuple[str, ...] = ("curso_ord", "pos")) -> DataFrame:
    """rows with ``inst_id``: that of the key's first row; blank names are dropped."""
    named = rows.where(F.length(F.trim(F.coalesce("nome", F.lit("")))) > 0)
    first = named.groupBy(*keys).agg(F.min_by("id", F.struct(*order)).alias("inst_id"))
    return named.join(first, list(keys))


def known_offers(offers: DataFrame, institutions: DataFrame) -> DataFrame:
    """The offers (inst_id, course_id, pos) whose institution is known."""
    return offers.join(institutions.select(F.col("id").alias("inst_id")).distinct(), "inst_id", "left_semi")


def gather_offers(institutions: DataFrame, offers: DataFrame) -> DataFrame:
    """institutions with ``cursos_ofertados_ids``: their distinct course ids as first seen; [] if none.

    Offers are reduced to one row for each pair before they are gathered.
    """
    pairs = offers.groupBy("inst_id", "course_id").agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "course_id"))), lambda x: x["course_id"])
    lists = pairs.groupBy(F.col("inst_id").alias("id")).agg(ordered.alias("cursos_ofertados_ids"))
    return institutions.join(lists, "id", "left").withColumn("cursos_ofertados_ids", F.coalesce("cursos_ofertados_ids", F.array().cast("array<bigint>")))


def aggregate(institutions: DataFrame, offers: DataFrame, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The 15 columns of the institutions file: raw columns, address parts (by ``parse`` if given) and the course list as JSON."""
    df = gather_offers(institutions, offers).drop(*PARTS)
    df = parse(df) if parse else with_parsed_address(df, "p", F.col("endereco")).select("*", *[F.coalesce(f"p.{x}", F.lit("")).alias(x) for x in PARTS]).drop("p")
    return df.select(
        F.col("id").alias("snowflake_id"), "nome_instituicao", "dependencia_adm", "endereco", *PARTS, "telefone", "email", "homepage",
        F.to_json("cursos_ofertados_ids").alias("cursos_ofertados_ids"),
    )


def rewritten(rows: DataFrame) -> DataFrame:
    """Any institutions file in the 15 columns: the row's own filled values win over parsed ones, alternates of names are taken, [] stands for no courses."""
    have = set(rows.columns)
    text = lambda *names: first_filled(*[F.col(n) for n in names if n in have])
    df = with_parsed_address(rows, "p", text("endereco"))
    return df.select(
        text("snowflake_id", "id").alias("snowflake_id"), text("nome_instituicao", "nome").alias("nome_instituicao"), text("dependencia_adm").alias("dependencia_adm"), text("endereco").alias("endereco"),
        *[first_filled(*([F.col(x)] if x in have else []), F.col(f"p.{x}")).alias(x) for x in PARTS],
        *[text(n).alias(n) for n in ("telefone", "email", "homepage")],
        F.coalesce(filled(text("cursos_ofertados_ids")), F.lit("[]")).alias("cursos_ofertados_ids"),
    )
