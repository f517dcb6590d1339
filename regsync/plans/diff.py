"""The whole comparison of a batch with a registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import first_filled
from ..functions.keys import with_batch_keys, with_registry_keys
from ..operators.audit import audit
from ..operators.classify import classify, course_changes, course_counts
from ..operators.components import cut, cut_all, spread
from ..operators.matching import cascade, match
from ..schemas import normalize_columns

#: A batch under this share of the registry is a partial load, which inactivates nothing.
PARTIAL = 0.8
STATUSES = ("novo", "alterado", "mantido", "reativado", "inativado")


@dataclass
class RegistryDiff:
    """rows: every batch row that isn't skipped, once, and the inactivated registry rows; course_details; summary: one row."""

    rows: DataFrame
    course_details: DataFrame
    summary: DataFrame
    partial: bool


def compare(registry: DataFrame, batch: DataFrame, partial: bool | None = None, registry_order: str | None = None, batch_order: str | None = None, uf_in_key: bool = False, exact: bool = True) -> RegistryDiff:
    """Matches, classifies, inactivates and audits.

    exact: the sequential matching, else the faster cascade by tiers.  Inactivation looks at the matches of the tiers
    only, so a registry row that the audit finds may also be among the inactivated.
    """
    registry, batch = map(spread, cut_all(normalize_columns(registry, registry_order), normalize_columns(batch, batch_order)))
    total_db, total_csv = registry.count(), batch.count()
    if partial is None:
        partial = total_db > 0 and total_csv < PARTIAL * total_db
    own, theirs = cut_all(with_batch_keys(batch, uf_in_key), with_registry_keys(registry, uf_in_key))
    if exact:
        pairs = cut(match(own, theirs))
    else:
        pairs = cascade(own, theirs)
    c = F.col
    db = theirs.select(c("ord").alias("db_ord"), *[c(n).alias(f"d_{n}") for n in ("id", "nome", "endereco", "municipio", "muni", "uf", "ativo", "cursos")])
    joined = own.join(pairs.withColumnRenamed("csv_ord", "ord"), "ord").join(db, "db_ord")
    matched = classify(joined)
    none = lambda kind: F.lit(None).cast(kind)
    fresh = own.join(pairs.select(c("csv_ord").alias("ord")), "ord", "left_anti").select(
        F.lit("novo").alias("status"), "ord", none("long").alias("id"), "nome", c("muni").alias("municipio"), c("key_uf").alias("uf"), first_filled(c("cep_val"), c("cep")).alias("cep"), "endereco",
        none("string").alias("endereco_db"), F.array().cast("array<string>").alias("diferencas"), "dependencia_adm", "telefone", "email", "homepage", "cursos",
        none("string").alias("nome_db"), F.array().cast("array<string>").alias("cursos_db"), none("long").alias("db_ord"), none("long").alias("tier"),
    )
    matched, fresh = cut_all(matched, fresh)
    rescued = cut(audit(fresh, theirs))
    still = fresh.join(rescued.select("ord"), "ord", "left_anti").select(*fresh.columns)
    gone = registry.where("ativo = 1").join(pairs.select(c("db_ord").alias("ord")).distinct(), "ord", "left_anti")
    gone = gone.where(F.lit(not partial)).select(
        F.lit("inativado").alias("status"), none("long").alias("ord"), "id", "nome", "municipio", "uf", "cep", "endereco", none("string").alias("endereco_db"), F.array().cast("array<string>").alias("diferencas"),
        "dependencia_adm", "telefone", "email", "homepage", F.array().cast("array<string>").alias("cursos"), c("nome").alias("nome_db"), c("cursos").alias("cursos_db"), c("ord").alias("db_ord"), none("long").alias("tier"),
    )
    rows = matched.unionByName(still).unionByName(rescued).unionByName(gone)
    rows = rows.withColumns({"is_novo": c("status") == "novo", "reativar": c("status") == "reativado", "ativo": F.when(c("status") == "inativado", 0).otherwise(1)})
    rows = cut(rows)
    counts = rows.agg(*[F.sum((c("status") == s).cast("long")).alias(f"{s}s_qtd") for s in STATUSES])
    courses = own.select(F.explode("cursos").alias("x")).agg(F.count_distinct("x").alias("cursos_unicos_csv_qtd"))
    summary = counts.select(*[F.coalesce(x, F.lit(0)).alias(x) for x in counts.columns]).crossJoin(courses).crossJoin(course_counts(matched, fresh, partial))
    summary = summary.withColumns({"total_csv": F.lit(total_csv).cast("long"), "total_db": F.lit(total_db).cast("long"), "is_parcial": F.lit(partial)})
    return RegistryDiff(rows, course_changes(matched, partial), summary, partial)
