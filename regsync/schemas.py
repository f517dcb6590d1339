"""Schemas and the mapping of column aliases onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.base import first_filled

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


REGISTRY = _struct(
    id=T.LongType(), nome_instituicao=_S, dependencia_adm=_S, endereco=_S, logradouro=_S, numero=_S, complemento=_S, bairro=_S, municipio=_S, uf=_S, cep=_S,
    telefone=_S, email=_S, homepage=_S, ativo=T.IntegerType(), criado_em=T.TimestampType(), atualizado_em=T.TimestampType(),
)
COURSES = _struct(
    id=T.LongType(), id_original=T.IntegerType(), nome_curso=_S, eixo_tecnologico=_S, carga_horaria=_S, pre_requisito=_S, perfil_profissional=_S, itinerarios=_S,
    campo_atuacao=_S, ocupacoes_cbo=_S, infraestrutura_minima=_S, ativo=T.IntegerType(), criado_em=T.TimestampType(), atualizado_em=T.TimestampType(),
)
OFFERS = _struct(id=T.LongType(), instituicao_tecnica_id=T.LongType(), curso_tecnico_id=T.LongType(), criado_em=T.TimestampType())
AUDIT_LOG = _struct(
    id=T.LongType(), usuario_id=T.LongType(), usuario_email=_S, ip_origem=_S, data_hora=T.TimestampType(), total_inseridos=T.IntegerType(), total_atualizados=T.IntegerType(),
    total_inativados=T.IntegerType(), diagnostico_resumo=_S, criado_em=T.TimestampType(),
)
RELATIONS = _struct(inst_snowflake_id=T.LongType(), course_snowflake_id=T.LongType())
INSTITUTIONS_RAW = _struct(snowflake_id=T.LongType(), nome_instituicao=_S, dependencia_adm=_S, endereco=_S, telefone=_S, email=_S, homepage=_S)

# Other names under which a column may come.
ALIASES = {
    "id": ("id", "snowflake_id"),
    "nome": ("nome_instituicao", "nome"),
    "endereco": ("endereco", "endereco_original"),
    "municipio": ("municipio", "cidade"),
    "uf": ("uf",),
    "cep": ("cep",),
    "dependencia_adm": ("dependencia_adm", "dependencia"),
    "telefone": ("telefone",),
    "email": ("email",),
    "homepage": ("homepage", "site"),
}


def normalize_columns(df: DataFrame, order: str | None = None) -> DataFrame:
    """id, nome, endereco, municipio, uf, cep, dependencia_adm, telefone, email, homepage (texts never null), ativo, cursos and ord of any registry or batch.

    The first filled alias wins.  ord numbers the rows by the column ``order``, else as they come.
    """
    have = set(df.columns)
    cols = {}
    for name, aliases in ALIASES.items():
        found = [F.col(a) for a in aliases if a in have]
        if name == "id":
            cols[name] = F.coalesce(*[F.nullif(f.cast("long"), F.lit(0)) for f in found]) if found else F.lit(None).cast("long")
        else:
            cols[name] = first_filled(*found) if found else F.lit("")
    cols["ativo"] = F.coalesce(F.col("ativo").try_cast("int") if "ativo" in have else F.lit(1), F.lit(1))
    if "ativo" in have:
        cols["ativo"] = F.when(F.col("ativo").isNull() | (F.col("ativo").cast("string") == "1"), 1).otherwise(0)
    cols["cursos"] = F.coalesce(F.col("cursos").cast("array<string>"), F.array().cast("array<string>")) if "cursos" in have else F.array().cast("array<string>")
    cols["ord"] = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    return df.select(*[v.alias(k) for k, v in cols.items()])
