"""A registry, a batch and offers derived from the driver's tables, for queries, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.components import spread

MUNICIPALITIES = (
    "Porto Alegre", "São Paulo", "Itapajé", "Cuiabá", "Pedro II", "Esteio", "Fortaleza", "Manaus", "Belém", "Recife", "Natal", "Salvador", "Vitória",
    "Curitiba", "Palmas", "Goiânia", "Macapá", "Boa Vista", "Teresina", "Maceió", "Aracaju", "Campinas", "Santos", "Niterói", "Olinda",
)
STATES = ("RS", "SP", "CE", "MT", "PI")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One institution for each customer; every thirteenth is inactive."""
    towns, states = (F.array(*map(F.lit, x)) for x in (MUNICIPALITIES, STATES))
    df = spread(read(spark, sf_dir, "customer")).join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select(F.col("c_custkey").alias("id"), "c_name", "n_nationkey", "n_regionkey")
    df = df.withColumns({"municipio": F.element_at(towns, (F.col("n_nationkey") % 25 + 1).cast("int")), "uf": F.element_at(states, (F.col("n_regionkey") % 5 + 1).cast("int")), "cep": F.lpad((10000001 + 37 * F.col("id")).cast("string"), 8, "0")})
    address = F.format_string("Rua das Flores, %d, Centro, %s %s - %s", "id", "municipio", "uf", "cep")
    name = F.concat(F.lit("E.E. Prof. "), F.col("c_name"))
    return df.select("id", name.alias("nome_instituicao"), "municipio", "uf", "cep", address.alias("endereco"), (F.col("id") % 13 != 0).cast("int").alias("ativo"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a new collection finds it: rows dropped, names spelled out, addresses and municipalities changed, and one new institution for each supplier."""
    c = F.col
    reg = registry(spark, sf_dir).where("id % 10 <> 0")
    kind = c("id") % 10
    name = F.when(kind == 1, F.replace("nome_instituicao", F.lit("E.E. Prof. "), F.lit("Escola Estadual Professor "))).otherwise(c("nome_instituicao"))
    other = F.format_string("Avenida Nova Esperança, %d, Bairro Novo, %s %s - %s", "id", "municipio", "uf", "cep")
    bare = F.format_string("Rua das Flores, Centro, %s %s - %s", "municipio", "uf", "cep")
    address = F.when(kind == 2, other).when(kind == 4, bare).otherwise(c("endereco"))
    town = F.when(kind == 3, F.format_string("%s %s - %s", "municipio", "uf", "cep")).otherwise(c("municipio"))
    old = reg.select(c("id").alias("pos"), name.alias("nome_instituicao"), town.alias("municipio"), "uf", address.alias("endereco"))
    towns, states = (F.array(*map(F.lit, x)) for x in (MUNICIPALITIES, STATES))
    sup = read(spark, sf_dir, "supplier").select((c("s_suppkey") + 10_000_000).alias("pos"), F.concat(F.lit("Centro de Treinamento "), c("s_name")).alias("nome_instituicao"), F.element_at(towns, (c("s_nationkey") % 25 + 1).cast("int")).alias("municipio"), F.element_at(states, (c("s_suppkey") % 5 + 1).cast("int")).alias("uf"), c("s_suppkey"))
    new = sup.select("pos", "nome_instituicao", "municipio", "uf", F.format_string("Travessa do Porto, %d, Cais, %s %s", c("s_suppkey") + 500000, "municipio", "uf").alias("endereco"))
    return old.unionByName(new)


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that each tier of the matching is needed for, by the last digit of the registry's id.

    1: another generic word in the name (tier 2); 2: another town (3); 3: the name's words in another order (4); 4: another name
    (5); 5: also no postal code (6); 6: another town and state (7); 7: once more the row whose id ends in 0 (8); 9: unknown.
    """
    c = F.col
    reg = registry(spark, sf_dir)
    kind = c("id") % 10
    own = F.when(kind == 7, c("id") - 7).otherwise(c("id"))
    first = reg.where("id % 10 = 0").select((c("id") + 7).alias("id"), *[c(n).alias(f"f_{n}") for n in ("nome_instituicao", "municipio", "uf", "endereco")])
    df = reg.join(first, "id", "left").where(~((kind == 7) & c("f_uf").isNull()))
    town = F.when(kind.isin(2, 6), "Xique Xique").otherwise(F.coalesce("f_municipio", "municipio"))
    uf = F.when(kind == 6, "AM").otherwise(F.coalesce("f_uf", "uf"))
    name = F.coalesce("f_nome_instituicao", "nome_instituicao")
    name = F.when(kind == 1, F.concat(F.lit("Colégio "), name)).when(kind == 3, F.concat(F.replace(name, F.lit("E.E. Prof. "), F.lit("")), F.lit(" Prof. E.E."))).when(kind.isin(4, 5, 9), F.format_string("Liceu Novo %d", "id")).otherwise(name)
    end = F.when(kind == 5, "").otherwise(F.concat(F.lit(" - "), "cep"))
    street = F.when(kind == 9, "Beco Torto").otherwise("Rua das Flores")
    address = F.when(kind.isin(0, 7), F.coalesce("f_endereco", "endereco")).otherwise(F.concat(street, F.lit(", "), F.when(kind == 9, own + 700000).otherwise(own).cast("string"), F.lit(", Centro, "), town, F.lit(" "), uf, F.when(kind == 9, "").otherwise(end)))
    return df.select(c("id").alias("pos"), name.alias("nome_instituicao"), town.alias("municipio"), uf.alias("uf"), address.alias("endereco"))


def hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tiered`` and rows that only the audit finds, for registry ids that end in 9: by postal code, by street, by words of the name, by a core name whose row is taken."""
    c = F.col
    reg = registry(spark, sf_dir)
    before = reg.select((c("id") + 1).alias("id"), c("nome_instituicao").alias("before"))
    df = reg.where("id % 10 = 9").join(before, "id", "left")
    kind = F.expr("(id div 10) % 4")
    name = F.when(kind == 0, F.format_string("Casa Azul %d", "id")).when(kind == 1, F.format_string("Casa Verde %d", "id")).when(kind == 2, F.concat(F.lit("Predio "), F.replace("nome_instituicao", F.lit("E.E. "), F.lit("")))).otherwise(c("before"))
    address = F.when(kind == 0, F.format_string("Beco Curto, Centro, %s %s - %s", "municipio", "uf", "cep")).when(kind == 1, F.format_string("Rua das Flores, %d, Centro, %s", "id", "municipio")).otherwise("")
    own = df.select((c("id") + 1_000_000).alias("pos"), name.alias("nome_instituicao"), F.when(kind == 3, "Xique Xique").otherwise(c("municipio")).alias("municipio"), F.when(kind == 3, "AM").when(kind == 0, c("uf")).otherwise("").alias("uf"), address.alias("endereco"))
    return tiered(spark, sf_dir).unionByName(own)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst_id, course_id, pos): the parts that a customer's orders hold, as courses that an institution offers."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("inst_id"), F.col("l_partkey").alias("course_id"), pos.alias("pos"))
