"""Attribute-level differences of matched rows, and differences of their course sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import dedupe_address, split_municipality, with_known_address
from ..functions.base import filled, first_filled, fold, strip
from ..functions.text import richness

ARROW = "➔"


def change(name: str, old: Column, new: Column) -> Column:
    return F.concat(F.lit(f"{name}: '"), old, F.lit(f"' {ARROW} '"), new, F.lit("'"))


def same_or_longer(native: Column, candidate: Column) -> Column:
    """Whether the native municipality is the candidate or begins with it."""
    a, b = fold(native), fold(candidate)
    return (a == b) | ((F.length(a) > F.length(b)) & a.startswith(b))


def name_change(new: Column, old: Column) -> Column:
    """A name is replaced only by a richer one."""
    return (new != "") & (old != "") & (fold(new) != fold(old)) & (richness(new) > richness(old))


def address_change(new: Column, old: Column, contained: bool = True) -> Column:
    """An address is replaced by a different one of 0.8 times the old one's length or more; one that is part of the old one isn't different."""
    a, b = fold(new), fold(old)
    out = (a != "") & (b != "") & (a != b)
    long_enough = lambda x, y: F.length(x) >= (F.length(y) * F.lit(0.8)).cast("int")
    return out & ~F.contains(b, a) & long_enough(new, old) if contained else out & long_enough(a, b)


def sequence_changes(df: DataFrame, uf: str, cep: str, db_uf: str, db_cep: str, first: list[Column], last: Column) -> DataFrame:
    """df with ``diferencas``: a blank state or code of the registry is filled only along with a change found before it."""
    df = df.withColumn("__d", F.filter(F.array(*first), lambda x: x.isNotNull()))
    for name, new, old in (("uf", uf, db_uf), ("cep", cep, db_cep)):
        n, o = F.col(new), F.col(old)
        differs = fold(F.col(uf)).substr(1, 2) != fold(o).substr(1, 2) if name == "uf" else n != o
        said = F.when((n != "") & (o != "") & differs, change(name, o, n)).when((n != "") & (o == "") & (F.size("__d") > 0), change(name, F.lit(""), n))
        df = df.withColumn("__d", F.when(said.isNotNull(), F.array_append("__d", said)).otherwise(F.col("__d")))
    return df.withColumn("diferencas", F.when(last.isNotNull(), F.array_append("__d", last)).otherwise(F.col("__d"))).drop("__d")


def classify(matched: DataFrame) -> DataFrame:
    """Status of matched rows: reativado, alterado or mantido.

    matched: a keyed batch row, whose ``placed`` is parsed anew only if the municipality or state differs here, with db_ord and the registry row's columns as d_id, d_nome, d_endereco, d_municipio,
    d_muni, d_uf, d_ativo and d_cursos.  The registry's postal code isn't compared here, but only by the audit.
    """
    c = F.col
    df = matched.withColumns(
        {
            "end_new": dedupe_address(strip(c("endereco"))),
            "end_old": dedupe_address(strip(c("d_endereco"))),
            "muni_old": first_filled(c("d_municipio"), c("d_muni")),
            "uf_old": strip(c("d_uf")),
            "cep_old": F.lit(""),
        }
    )
    df = df.withColumn("s", split_municipality(c("muni_old")))
    df = df.withColumns({"m": first_filled(c("muni"), c("s.muni")), "c": first_filled(c("cep"), c("cep_val"), c("ext_cep"), c("s.cep"))})
    own = (c("endereco"), c("m"), c("uf_given"))
    same = (c("m") == c("muni")) & (c("uf_given") == c("uf2")) & c("placed").isNotNull()
    df = with_known_address(df, "p", *own, c("placed"), same).withColumn("p", F.when(c("endereco") != "", c("p")))
    town = c("p.municipio")
    df = df.withColumns(
        {
            "m": F.when(filled(town).isNotNull() & ~same_or_longer(c("m"), town), town).otherwise(c("m")),
            "u": first_filled(c("p.uf"), c("key_uf"), c("ext_uf"), c("s.uf")),
            "c": first_filled(c("p.cep"), c("c")),
        }
    )
    first = [
        F.when(name_change(c("nome"), c("d_nome")), change("nome_instituicao", c("d_nome"), c("nome"))),
        F.when((c("m") != "") & (fold(c("m")) != fold(c("muni_old"))), change("municipio", c("muni_old"), c("m"))),
    ]
    last = F.when(address_change(c("end_new"), c("end_old")), change("endereco", c("end_old"), c("end_new")))
    df = sequence_changes(df, "u", "c", "uf_old", "cep_old", first, last)
    back, changed = c("d_ativo") == 0, F.size("diferencas") > 0
    return df.select(
        F.when(back, "reativado").when(changed, "alterado").otherwise("mantido").alias("status"),
        "ord", c("d_id").alias("id"), "nome",
        F.when(back, c("muni")).otherwise(c("m")).alias("municipio"),
        F.when(back, c("key_uf")).otherwise(c("u")).alias("uf"),
        F.when(back, first_filled(c("cep_val"), c("cep"))).otherwise(c("c")).alias("cep"),
        F.when(~back & changed, c("end_new")).otherwise(c("endereco")).alias("endereco"),
        F.when(~back & changed, c("end_old")).alias("endereco_db"),
        F.when(back, F.array().cast("array<string>")).otherwise(c("diferencas")).alias("diferencas"),
        "dependencia_adm", "telefone", "email", "homepage", "cursos", c("d_nome").alias("nome_db"), c("d_cursos").alias("cursos_db"), "db_ord", "tier",
    )


def course_changes(matched: DataFrame, partial: bool) -> DataFrame:
    """(id, nome_instituicao, tipo, curso) of courses added and, on a full load, closed."""
    own, old = F.array_distinct("cursos"), F.array_distinct("cursos_db")
    kinds = [("Nova Oferta", F.array_except(own, old))] + ([] if partial else [("Encerrado", F.array_except(old, own))])

    def named(kind):
        return lambda x: F.struct(F.lit(kind).alias("tipo"), x.alias("curso"))

    both = F.flatten(F.array(*[F.transform(a, named(k)) for k, a in kinds]))
    return matched.select("id", F.col("nome").alias("nome_instituicao"), F.explode(both).alias("x")).select("id", "nome_instituicao", "x.tipo", "x.curso")


def course_counts(matched: DataFrame, fresh: DataFrame, partial: bool) -> DataFrame:
    """One row: novos, descontinuados (0 on a partial load), mantidos; unmatched rows add all their courses."""
    own, old = F.array_distinct("cursos"), F.array_distinct("cursos_db")
    a = matched.agg(F.sum(F.size(F.array_except(own, old))).alias("n"), F.sum(F.size(F.array_except(old, own))).alias("x"), F.sum(F.size(F.array_intersect(own, old))).alias("k"))
    b = fresh.agg(F.sum(F.size("cursos")).alias("f"))
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return a.crossJoin(b).select((n("n") + n("f")).alias("novos_cursos_qtd"), (F.lit(0).cast("long") if partial else n("x")).alias("cursos_descontinuados_qtd"), n("k").alias("cursos_mantidos_qtd"))
