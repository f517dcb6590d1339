"""Mapping of the catalogue's records onto rows, and the projections that views use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import PARTS, with_parsed_address
from ..functions.base import filled, first_filled
from ..functions.text import sentinel

#: The catalogue's course and institution records.
COURSE_JSON = "id INT, nome STRING, areasTecnologicas ARRAY<STRUCT<id: INT, nome: STRING>>, cargaHoraria STRING, preRequisito STRING, perfilProfissional STRING, itinerarios STRING, campoAtuacao STRING, ocupacoesCbo STRING, infraestruturaMinima STRING"
INSTITUTION_JSON = "nome STRING, tipo STRING, endereco STRING, telefone STRING, email STRING, site STRING, uf STRING, cidade STRING, municipio STRING"

_COURSE = (("nome_curso", "nome"), ("carga_horaria", "cargaHoraria"), ("pre_requisito", "preRequisito"), ("perfil_profissional", "perfilProfissional"), ("itinerarios", "itinerarios"), ("campo_atuacao", "campoAtuacao"), ("ocupacoes_cbo", "ocupacoesCbo"), ("infraestrutura_minima", "infraestruturaMinima"))

#: The columns of the course preview.
PREVIEWED_COURSE = ("snowflake_id", "id_original", "nome_curso", "eixo_tecnologico", "carga_horaria", "pre_requisito", "perfil_profissional", "itinerarios", "campo_atuacao", "ocupacoes_cbo", "infraestrutura_minima")


def course_records(raw: DataFrame, original_id: str = "id") -> DataFrame:
    """Course rows: renamed fields, the first technological area's name as axis, a mark for missing texts."""
    axis = F.get("areasTecnologicas", F.lit(0))["nome"]
    fields = {new: sentinel(F.col(old)).alias(new) for new, old in _COURSE}
    return raw.select(F.col(original_id).cast("int").alias("id_original"), fields.pop("nome_curso"), sentinel(axis).alias("eixo_tecnologico"), *fields.values())


def valid_courses(raw: DataFrame, most: int = 215) -> DataFrame:
    """The first ``most`` courses by id that have a name."""
    return raw.where(F.length("nome") > 0).orderBy("id").limit(most)


def institution_records(raw: DataFrame) -> DataFrame:
    """Institution rows; the municipality comes as cidade or municipio."""
    s = lambda *names: sentinel(first_filled(*[F.col(n) for n in names]))
    return raw.select(
        s("nome").alias("nome_instituicao"), s("tipo").alias("dependencia_adm"), s("endereco").alias("endereco"), s("telefone").alias("telefone"),
        s("email").alias("email"), s("site").alias("homepage"), s("uf").alias("uf"), s("cidade", "municipio").alias("municipio"),
    )


def preview(batch: DataFrame) -> DataFrame:
    """Batch rows with their address parts: parsed without the given municipality, and parsed values win."""
    df = with_parsed_address(batch, "p", F.col("endereco"))
    have = set(batch.columns)
    parts = [first_filled(F.col(f"p.{x}"), *([F.col(x)] if x in have else [])).alias(x) for x in PARTS]
    return df.select(*[c for c in batch.columns if c not in PARTS], *parts)


def course_preview(batch: DataFrame) -> DataFrame:
    """The columns of a course file that a preview shows; the id and the name come under either of two names."""
    have = set(batch.columns)
    one = lambda *names: F.coalesce(*[filled(F.col(n)) for n in names if n in have], F.lit(None).cast("string"))
    alternates = {"snowflake_id": ("snowflake_id", "id"), "nome_curso": ("nome_curso", "nome")}
    return batch.select(*[one(*alternates.get(n, (n,))).alias(n) for n in PREVIEWED_COURSE])


def validation(batch: DataFrame) -> DataFrame:
    """Batch rows as a check of the comparison after clean-up takes them: parsed address parts in place of the row's own, parsed from the address alone."""
    have = set(batch.columns)
    one = lambda *names: first_filled(*[F.col(n) for n in names if n in have])
    df = with_parsed_address(batch, "p", one("endereco"))
    return df.select(
        one("snowflake_id", "id").alias("snowflake_id"), one("nome_instituicao", "nome").alias("nome_instituicao"), one("dependencia_adm").alias("dependencia_adm"), one("endereco").alias("endereco_original"), one("endereco").alias("endereco"),
        *[F.coalesce(f"p.{x}", F.lit("")).alias(x) for x in PARTS], *[one(n).alias(n) for n in ("telefone", "email", "homepage")],
    )


def registry_view(registry: DataFrame) -> DataFrame:
    """Active rows; only where street, municipality or state is blank do parsed parts fill in."""
    have = set(registry.columns)
    own = {x: F.coalesce(F.col(x).cast("string"), F.lit("")) if x in have else F.lit("") for x in PARTS}
    lacks = (own["logradouro"] == "") | (own["municipio"] == "") | (own["uf"] == "")
    df = with_parsed_address(registry.where("ativo = 1"), "p", F.col("endereco"))
    parts = [F.when(lacks, first_filled(own[x], F.col(f"p.{x}"))).otherwise(own[x]).alias(x) for x in PARTS]
    return df.select(*[c for c in registry.columns if c not in PARTS], *parts)


def courses_view(courses: DataFrame) -> DataFrame:
    """The columns of active courses that views show; absent texts are empty."""
    names = ["id", "id_original", "nome_curso", "eixo_tecnologico", "carga_horaria", "pre_requisito", "perfil_profissional", "itinerarios", "campo_atuacao", "ocupacoes_cbo", "infraestrutura_minima"]
    have = set(courses.columns)
    return courses.where("ativo = 1").select(*[F.col(n) if n in ("id", "id_original") else (F.coalesce(F.col(n), F.lit("")) if n in have else F.lit("")).alias(n) for n in names], "ativo")
