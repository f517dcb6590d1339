"""One query for each operator over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import domain
from .functions import address as A
from .functions import ids
from .functions import sql as names
from .functions import text as X
from .functions.base import filled, first_filled, fold
from .functions.keys import TIERS, with_batch_keys, with_registry_keys
from .operators import aggregate, audit, indexes, matching, quality, records, search
from .operators.classify import course_changes, course_counts
from .operators.components import cut, cut_all, spread
from .plans import dbsync, diff, duck, report, sync
from .schemas import normalize_columns
from .sources import database, files, scan
from .sources.database import Database

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


read = domain.read
_c = F.col


_KEPT: dict[tuple, object] = {}


def _once(f):
    """Keeps what several queries share, checkpointed, for a session and a folder."""

    def key_of(s, d, **kw):
        return (f.__name__, s.sparkContext.applicationId, d, *sorted(kw.items()))

    def call(s, d, **kw):
        key = key_of(s, d, **kw)
        if key not in _KEPT:
            _KEPT[key] = f(s, d, **kw)
        return _KEPT[key]

    call.kept = lambda s, d, **kw: key_of(s, d, **kw) in _KEPT
    return call


def forget() -> None:
    """Drops what queries have kept, so that the next ones run in full."""
    _KEPT.clear()


def _map(name: str, table: str, key: str, column: str, value, sql_value: str, out: str = "valor") -> None:
    """A query that applies a function to a whole column of a table."""
    _add(name, f"SELECT {key}, {sql_value} AS {out} FROM {table}")(lambda s, d: spread(read(s, d, table)).select(key, value(_c(column)).alias(out)))


def _reg(name: str, value, sql_value: str, side: str = "bat", out: str = "valor") -> None:
    """A query that applies a function to the registry or the batch."""
    key, make = ("pos", domain.batch) if side == "bat" else ("id", domain.registry)
    _add(name, duck.statement(f"{duck.REG}, {duck.BAT}" if side == "bat" else duck.REG, f"SELECT {key}, {sql_value} AS {out} FROM {side}"))(lambda s, d: make(s, d).select(key, value().alias(out)))


# scalar functions over whole documents and over the registry
_map("fold_text", "documents", "doc_id", "text", fold, duck.fold("text"))
_map("expand_abbrev", "documents", "doc_id", "text", X.expand, duck.expand("text"))
_map("core_name", "documents", "doc_id", "text", X.core_name, duck.core("text"))
_map("token_key", "documents", "doc_id", "text", lambda c: X.name_tokens(X.expand(c)), duck.tokens("text"))
_map("richness", "documents", "doc_id", "text", X.richness, duck.richness("text"))
_map("ead_flag", "documents", "doc_id", "text", X.distance_learning, duck.distance("text"))
_map("pedagogical_clean", "documents", "doc_id", "text", X.clean_pedagogical, duck.pedagogical("text"))
_map("sentinel_clean", "documents", "doc_id", "lang", X.sentinel, f"CASE WHEN coalesce(lang, '') = '' THEN 'não informado' ELSE {duck.strip('lang')} END")
_reg("muni_norm", lambda: A.normalize_municipality(_c("municipio")), duck.muni_norm("municipio"))
_reg("muni_valid", lambda: A.is_municipality(_c("municipio")), duck.is_muni("municipio"))
_reg("muni_clean", lambda: A.clean_municipality(_c("municipio")), duck.muni_clean("municipio"))
_reg("muni_uf", lambda: A.split_municipality(_c("municipio"))["uf"], duck.muni_uf("municipio"))
_reg("muni_cep", lambda: A.split_municipality(_c("municipio"))["cep"], duck.muni_cep("municipio"))
_reg("muni_protect", lambda: A.protect_municipality(_c("municipio"), F.substring("municipio", 1, 5)), duck.protect("municipio", "substring(municipio, 1, 5)"))
_reg("roman_flag", lambda: A.is_roman(F.element_at(F.split("municipio", " "), -1)), f"upper(string_split(municipio, ' ')[len(string_split(municipio, ' '))]) IN {duck.listed(A.ROMAN)}")
_reg("cep_extract", lambda: A.extract_cep(_c("endereco"))["cep"], duck.cep_of(duck.cep_text("endereco")))
_reg("cep_removed", lambda: A.extract_cep(_c("endereco"))["text"], duck.without_cep(duck.cep_text("endereco")))
_reg("cep_format", lambda: A.format_cep(_c("cep")), "CASE WHEN length(regexp_replace(cep, '[^0-9]', '', 'g')) = 8 THEN substring(cep, 1, 5) || '-' || substring(cep, 6, 3) ELSE regexp_replace(cep, '[^0-9]', '', 'g') END", "reg")
_reg("cep_valid", lambda: A.is_cep(_c("cep")), "length(regexp_replace(cep, '[^0-9]', '', 'g')) BETWEEN 5 AND 8", "reg")
_reg("address_dedupe", lambda: A.dedupe_address(F.concat("endereco", F.lit(", Cx. Postal 12, CENTRO"))), duck.dedupe("endereco || ', Cx. Postal 12, CENTRO'"))
_reg("natural_key", lambda: X.natural_key(_c("nome_instituicao"), A.normalize_municipality(_c("municipio")), _c("uf")), duck.natural_key("nome_instituicao", duck.muni_norm("municipio"), "uf"))
_SQL_NAMES = {
    "fold": ("rs_fold(nome_instituicao)", duck.fold("nome_instituicao")), "expand": ("rs_expand(nome_instituicao)", duck.expand("nome_instituicao")), "core": ("rs_core_name(nome_instituicao)", duck.core("nome_instituicao")),
    "tokens": ("rs_name_tokens(nome_instituicao)", duck.tokens("nome_instituicao")), "richness": ("rs_richness(nome_instituicao)", duck.richness("nome_instituicao")), "ead": ("rs_distance_learning(nome_instituicao)", duck.distance("nome_instituicao")),
    "norm": ("rs_muni_norm(municipio)", duck.muni_norm("municipio")), "muni": ("rs_muni_clean(municipio)", duck.muni_clean("municipio")), "muni_uf": ("rs_muni_uf(municipio)", duck.muni_uf("municipio")), "valid": ("rs_is_municipality(municipio)", duck.is_muni("municipio")),
    "cep": ("rs_cep(endereco)", duck.cep_of(duck.cep_text("endereco"))), "endereco": ("rs_dedupe_address(endereco)", duck.dedupe("endereco")), "chave": ("rs_natural_key(nome_instituicao, rs_muni_norm(municipio), uf)", duck.natural_key("nome_instituicao", duck.muni_norm("municipio"), "uf")),
}


@_add("sql_functions", duck.statement(f"{duck.REG}, {duck.BAT}", f"SELECT pos, {', '.join(f'{x} AS v_{n}' for n, (_, x) in _SQL_NAMES.items())} FROM bat"))
def sql_functions(s, d):
    """The functions by their SQL names, from SQL text."""
    names.register(s)
    domain.batch(s, d).createOrReplaceTempView("rs_bat")
    return s.sql(f"SELECT pos, {', '.join(f'{x} AS v_{n}' for n, (x, _) in _SQL_NAMES.items())} FROM rs_bat")


@_add("sql_udtf", duck.statement(duck.REG, "SELECT id, CAST(i AS INTEGER) AS ord, trim(string_split(endereco, ',')[i]) AS parte FROM reg, LATERAL (SELECT unnest(range(1, len(string_split(endereco, ',')) + 1)) AS i) WHERE trim(string_split(endereco, ',')[i]) <> ''"))
def sql_udtf(s, d):
    names.register(s)
    domain.registry(s, d).createOrReplaceTempView("rs_reg")
    return s.sql("SELECT id, p.ord, p.parte FROM rs_reg, LATERAL rs_address_parts(endereco) p")


_PARSED = ", ".join(f"p_{x} AS {x}" for x in A.PARTS)


@_add("address_parse", duck.statement(f"{duck.REG}, {duck.BAT}, {duck.parse_ctes('bat', 'x', 'endereco', 'municipio', 'uf')}", f"SELECT pos, {_PARSED} FROM x"))
def address_parse(s, d):
    return A.with_parsed_address(domain.batch(s, d), "p", _c("endereco"), _c("municipio"), _c("uf")).select("pos", "p.*")


@_add("address_parse_alone", duck.statement(f"{duck.REG}, {duck.BAT}, {duck.parse_ctes('bat', 'x', 'endereco', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}", f"SELECT pos, {_PARSED} FROM x"))
def address_parse_alone(s, d):
    return A.with_parsed_address(domain.batch(s, d), "p", _c("endereco")).select("pos", "p.*")


@_add("location_keys", duck.statement(f"{duck.REG}, {duck.BAT}, {duck.location_ctes('bat', 'x', 'endereco', 'municipio', 'uf')}", "SELECT pos, l_cep AS cep, l_num AS num, l_street AS street FROM x"))
def location_keys(s, d):
    return A.with_location(domain.batch(s, d), "l", _c("endereco"), _c("municipio"), _c("uf")).select("pos", "l.*")


# scans, filters and projections
@_add("scan_filter_active", duck.statement(duck.REG, "SELECT id, nome_instituicao, municipio, uf, endereco FROM reg WHERE ativo = 1"))
def scan_filter_active(s, d):
    return domain.registry(s, d).where("ativo = 1").select("id", "nome_instituicao", "municipio", "uf", "endereco")


@_add("project_alias_coalesce", "SELECT p_partkey AS id, coalesce(nullif(p_name, ''), nullif(p_brand, ''), '') AS nome, coalesce(nullif(p_type, ''), '') AS tipo FROM part")
def project_alias_coalesce(s, d):
    return read(s, d, "part").select(_c("p_partkey").alias("id"), first_filled(_c("p_name"), _c("p_brand")).alias("nome"), first_filled(_c("p_type")).alias("tipo"))


@_add("filter_blank_rows", duck.statement(f"{duck.REG}, {duck.BAT}", "SELECT pos FROM bat WHERE NOT (pos % 7 = 0 AND pos % 2 = 0)"))
def filter_blank_rows(s, d):
    df = domain.batch(s, d).withColumns({"nome_instituicao": F.when(_c("pos") % 7 == 0, "N/I").otherwise(_c("nome_instituicao")), "endereco": F.when(_c("pos") % 2 == 0, "não informado").otherwise(_c("endereco"))})
    return with_batch_keys(normalize_columns(df, "pos")).select(_c("ord").alias("pos"))


@_add("valid_courses", "SELECT p_partkey AS id, p_name AS nome FROM part WHERE length(p_name) > 0 AND p_partkey % 3 <> 0 ORDER BY p_partkey LIMIT 215")
def valid_courses(s, d):
    df = read(s, d, "part").select(_c("p_partkey").alias("id"), F.when(_c("p_partkey") % 3 != 0, _c("p_name")).otherwise("").alias("nome"))
    return records.valid_courses(df)


@_add("registry_view", duck.statement(f"{duck.REG}, {duck.parse_ctes('reg', 'x', 'endereco', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}", "SELECT id, coalesce(p_logradouro, '') AS logradouro, coalesce(p_numero, '') AS numero, coalesce(nullif(municipio, ''), p_municipio, '') AS municipio, coalesce(nullif(uf, ''), p_uf, '') AS uf, coalesce(nullif(cep, ''), p_cep, '') AS cep FROM x WHERE ativo = 1"))
def registry_view(s, d):
    return records.registry_view(domain.registry(s, d)).select("id", "logradouro", "numero", "municipio", "uf", "cep")


@_add("preview", duck.statement(f"{duck.REG}, {duck.BAT}, {duck.parse_ctes('bat', 'x', 'endereco', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}", "SELECT pos, nome_instituicao, coalesce(p_logradouro, '') AS logradouro, coalesce(nullif(p_municipio, ''), municipio, '') AS municipio, coalesce(nullif(p_uf, ''), uf, '') AS uf, coalesce(p_cep, '') AS cep FROM x"))
def preview(s, d):
    return records.preview(domain.batch(s, d)).select("pos", "nome_instituicao", "logradouro", "municipio", "uf", "cep")


@_add("courses_view", "SELECT p_partkey AS id, p_name AS nome_curso, p_type AS eixo_tecnologico, '' AS carga_horaria FROM part WHERE p_size % 2 = 0")
def courses_view(s, d):
    df = read(s, d, "part").select(_c("p_partkey").alias("id"), _c("p_size").alias("id_original"), _c("p_name").alias("nome_curso"), _c("p_type").alias("eixo_tecnologico"), (_c("p_size") % 2 == 0).cast("int").alias("ativo"))
    return records.courses_view(df).select("id", "nome_curso", "eixo_tecnologico", "carga_horaria")


@_add("institution_records", "SELECT s_suppkey AS id, s_name AS nome_instituicao, 'não informado' AS email, 'não informado' AS municipio FROM supplier")
def institution_records(s, d):
    df = read(s, d, "supplier").select(_c("s_suppkey"), _c("s_name").alias("nome"), *[F.lit(v).cast("string").alias(k) for k, v in (("tipo", "Privada"), ("endereco", ""), ("telefone", None), ("email", ""), ("site", None), ("uf", None), ("cidade", ""), ("municipio", None))])
    joined = records.institution_records(df).select(_c("nome_instituicao"), "email", "municipio")
    return read(s, d, "supplier").join(joined, _c("s_name") == _c("nome_instituicao")).select(_c("s_suppkey").alias("id"), "nome_instituicao", "email", "municipio")


@_add("json_first_area", "SELECT p_partkey AS id, p_name AS nome_curso, coalesce(nullif(p_type, ''), 'não informado') AS eixo_tecnologico FROM part")
def json_first_area(s, d):
    body = F.to_json(F.struct(_c("p_partkey").alias("id"), _c("p_name").alias("nome"), F.array(F.struct(_c("p_type").alias("nome")), F.struct(F.lit("outra").alias("nome"))).alias("areasTecnologicas")))
    raw = read(s, d, "part").select(F.from_json(body, records.COURSE_JSON).alias("r")).select("r.*")
    return records.course_records(raw).select(_c("id_original").cast("long").alias("id"), "nome_curso", "eixo_tecnologico")


@_add("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_props(s, d):
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_add("url_quote", "SELECT n_nationkey, replace(replace(url_encode(n_name || ' técnico'), '+', '%20'), '%2B', '%2B') AS valor FROM nation")
def url_quote(s, d):
    return read(s, d, "nation").select("n_nationkey", F.replace(F.url_encode(F.concat("n_name", F.lit(" técnico"))), F.lit("+"), F.lit("%20")).alias("valor"))


# offers
_OFFERS = "offers AS (SELECT o_custkey AS inst_id, l_partkey AS course_id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@_add("offers_agg", duck.statement(_OFFERS + ", pairs AS (SELECT inst_id, course_id, min(pos) AS pos FROM offers GROUP BY ALL)", "SELECT c_custkey AS id, coalesce((SELECT string_agg(CAST(course_id AS VARCHAR), ',' ORDER BY pos, course_id) FROM pairs WHERE inst_id = c_custkey), '') AS cursos FROM customer"))
def offers_agg(s, d):
    inst = read(s, d, "customer").select(_c("c_custkey").alias("id"))
    out = aggregate.gather_offers(inst, domain.offers(s, d))
    return out.select("id", F.array_join("cursos_ofertados_ids", ",").alias("cursos"))


@_add("json_course_list", duck.statement(_OFFERS + ", pairs AS (SELECT inst_id, course_id, min(pos) AS pos FROM offers GROUP BY ALL)", "SELECT c_custkey AS id, '[' || coalesce((SELECT string_agg(CAST(course_id AS VARCHAR), ',' ORDER BY pos, course_id) FROM pairs WHERE inst_id = c_custkey), '') || ']' AS cursos FROM customer"))
def json_course_list(s, d):
    reg = domain.registry(s, d).withColumns({c: F.lit("") for c in ("dependencia_adm", "telefone", "email", "homepage")})
    return aggregate.aggregate(reg, domain.offers(s, d)).select(_c("snowflake_id").alias("id"), _c("cursos_ofertados_ids").alias("cursos"))


_INSTITUTIONS = ", ".join(f"coalesce(p_{x}, '') AS {x}" for x in A.PARTS)


@_add("aggregate_columns", duck.statement(f"{_OFFERS}, pairs AS (SELECT inst_id, course_id, min(pos) AS pos FROM offers GROUP BY ALL), {duck.REG}, {duck.parse_ctes('reg', 'x', 'endereco', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}", f"SELECT id AS snowflake_id, nome_instituicao, '' AS dependencia_adm, endereco, {_INSTITUTIONS}, '' AS telefone, '' AS email, '' AS homepage, '[' || coalesce((SELECT string_agg(CAST(course_id AS VARCHAR), ',' ORDER BY pos, course_id) FROM pairs WHERE inst_id = id), '') || ']' AS cursos_ofertados_ids FROM x"))
def aggregate_columns(s, d):
    reg = domain.registry(s, d).withColumns({c: F.lit("") for c in ("dependencia_adm", "telefone", "email", "homepage")})
    return aggregate.aggregate(reg, domain.offers(s, d))


_OWN_WINS = ", ".join(f"coalesce(nullif({x}, ''), p_{x}, '') AS {x}" if x in ("municipio", "uf", "cep") else f"coalesce(p_{x}, '') AS {x}" for x in A.PARTS)


@_add("rewrite_columns", duck.statement(f"{duck.REG}, half AS (SELECT id, nome_instituicao, endereco, CASE WHEN id % 2 = 0 THEN municipio || ' Novo' END AS municipio, CASE WHEN id % 3 = 0 THEN uf ELSE '' END AS uf, CASE WHEN id % 5 = 0 THEN cep END AS cep, CASE WHEN id % 7 = 0 THEN '[7]' END AS cursos FROM reg), {duck.parse_ctes('half', 'x', 'endereco', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}", f"SELECT CAST(id AS VARCHAR) AS snowflake_id, nome_instituicao, '' AS dependencia_adm, endereco, {_OWN_WINS}, '' AS telefone, '' AS email, '' AS homepage, coalesce(cursos, '[]') AS cursos_ofertados_ids FROM x"))
def rewrite_columns(s, d):
    kind = lambda n, v, e=None: F.when(_c("id") % n == 0, v).otherwise(F.lit(e))
    half = domain.registry(s, d).select("id", _c("nome_instituicao").alias("nome"), "endereco", kind(2, F.concat("municipio", F.lit(" Novo"))).alias("municipio"), kind(3, _c("uf"), "").alias("uf"), kind(5, _c("cep")).alias("cep"), kind(7, F.lit("[7]")).alias("cursos_ofertados_ids"))
    return aggregate.rewritten(half)


@_add("course_preview", "SELECT CAST(p_partkey AS VARCHAR) AS snowflake_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE nullif(p_brand, '') END AS nome_curso, p_type AS eixo_tecnologico, CAST(NULL AS VARCHAR) AS carga_horaria FROM part")
def course_preview(s, d):
    df = read(s, d, "part").select(_c("p_partkey").alias("id"), F.when(_c("p_size") % 2 == 0, _c("p_name")).otherwise("").alias("nome_curso"), _c("p_brand").alias("nome"), _c("p_type").alias("eixo_tecnologico"))
    return records.course_preview(df).select("snowflake_id", "nome_curso", "eixo_tecnologico", "carga_horaria")


@_add("validation_view", duck.statement(f"{duck.REG}, {duck.BAT}, {duck.parse_ctes('bat', 'x', 'endereco', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}", f"SELECT CAST(pos AS VARCHAR) AS snowflake_id, nome_instituicao, endereco AS endereco_original, endereco, {_INSTITUTIONS} FROM x"))
def validation_view(s, d):
    return records.validation(domain.batch(s, d).withColumnRenamed("pos", "id")).select("snowflake_id", "nome_instituicao", "endereco_original", "endereco", *A.PARTS)


@_add("offers_unknown_dropped", duck.statement(_OFFERS, "SELECT inst_id, count(*) AS n FROM offers JOIN customer ON inst_id = c_custkey WHERE c_custkey % 3 = 0 GROUP BY inst_id"))
def offers_unknown_dropped(s, d):
    inst = read(s, d, "customer").where("c_custkey % 3 = 0").select(_c("c_custkey").alias("id"))
    return aggregate.known_offers(domain.offers(s, d), inst).groupBy("inst_id").agg(F.count("*").alias("n"))


@_add("first_by_name", "SELECT p_name AS nome, min(p_partkey) AS id, count(*) AS linhas FROM part WHERE trim(p_name) <> '' GROUP BY p_name")
def first_by_name(s, d):
    df = read(s, d, "part").select(_c("p_name").alias("nome"), _c("p_partkey").alias("id"), _c("p_partkey").alias("curso_ord"), F.lit(0).alias("pos"))
    return aggregate.institution_ids(df).groupBy("nome", _c("inst_id").alias("id")).agg(F.count("*").alias("linhas"))


# matching by tiers
@_once
def _sides(s, d):
    return cut_all(with_batch_keys(normalize_columns(domain.batch(s, d), "pos")), with_registry_keys(normalize_columns(domain.registry(s, d), "id")))


@_once
def _tiered_sides(s, d):
    return cut(with_batch_keys(normalize_columns(domain.tiered(s, d), "pos"))), _sides(s, d)[1]


#: What only the parsing of all addresses gives; queries that don't need it don't pay for it.
_LOCATED = ("cep_val", "num", "street", "k5", "k6", "placed")


@_once
def _named_sides(s, d):
    """``_sides`` without what lies in the addresses."""
    return cut_all(with_batch_keys(normalize_columns(domain.batch(s, d), "pos")).drop(*_LOCATED), with_registry_keys(normalize_columns(domain.registry(s, d), "id")).drop(*_LOCATED))


@_once
def _named_tiered(s, d):
    return cut(with_batch_keys(normalize_columns(domain.tiered(s, d), "pos")).drop(*_LOCATED))


def _by_name(s, d):
    """Sides with the keys of names and municipalities: the whole ones if they are kept already."""
    return _sides(s, d) if _sides.kept(s, d) else _named_sides(s, d)


def _tier(name: str, key: str, policy: str) -> None:
    heads = f"heads AS (SELECT {key}, min(ord) AS db_ord, count(*) AS n FROM rk WHERE {key} IS NOT NULL GROUP BY {key})"
    sql = duck.statement(f"{duck.keys_ctes()}, {heads}", f"SELECT b.ord AS csv_ord, h.db_ord FROM bk b JOIN heads h USING ({key}){' WHERE n = 1' if policy == 'sole' else ''}")
    sides = _sides if key in _LOCATED else _by_name
    _add(name, sql)(lambda s, d: matching.tier_match(*sides(s, d), key, policy))


for _name, (_key, _policy) in zip(("tier1", "tier2", "tier3", "tier4", "tier5", "tier6", "tier65"), TIERS, strict=True):
    _tier(_name, _key, _policy)

_HEADS = ", ".join(f"h_{k} AS (SELECT {k}, min(ord) AS o_{k} FROM rk WHERE {k} IS NOT NULL GROUP BY {k})" for k in ("k1", "k2", "k5"))


@_add("tier7_fallback", duck.statement(f"{duck.keys_ctes()}, {_HEADS}", "SELECT csv_ord, db_ord FROM (SELECT b.ord AS csv_ord, coalesce(o_k1, CASE WHEN b.k2 IS NOT NULL THEN o_k2 ELSE o_k5 END) AS db_ord FROM bk b LEFT JOIN h_k1 USING (k1) LEFT JOIN h_k2 USING (k2) LEFT JOIN h_k5 USING (k5)) WHERE db_ord IS NOT NULL"))
def tier7_fallback(s, d):
    return matching.fallback(*_sides(s, d))


@_add("match_keys", duck.statement(duck.keys_ctes(), "SELECT ord, k1, k2, k3, k4, k5, k6, k7 FROM bk"))
def match_keys(s, d):
    return _sides(s, d)[0].select("ord", *[k for k, _ in TIERS])


@_add("registry_keys", duck.statement(duck.keys_ctes(), "SELECT ord, k1, k2, k3, k4, k5, k6, k7 FROM rk"))
def registry_keys(s, d):
    return _sides(s, d)[1].select("ord", *[k for k, _ in TIERS])


@_add("match_cascade", duck.statement(duck.keys_ctes(), "SELECT b.ord AS csv_ord, r.ord AS db_ord, CAST(1 AS BIGINT) AS tier FROM bk b JOIN rk r ON b.k1 = r.k1"))
def match_cascade(s, d):
    return matching.cascade(*_sides(s, d))


def _contention(s, d):
    df = read(s, d, "part").select(_c("p_partkey").alias("ord"), _c("p_name").alias("nome_instituicao"), F.lit("Esteio").alias("municipio"), F.lit("RS").alias("uf"))
    return with_batch_keys(normalize_columns(df, "ord")), with_registry_keys(normalize_columns(df, "ord"))


_PARTS_REG = "reg AS (SELECT p_partkey AS id, p_name AS nome_instituicao, 'Esteio' AS municipio, 'RS' AS uf, '' AS cep, '' AS endereco, 1 AS ativo FROM part)"
_PARTS_BAT = "bat AS (SELECT p_partkey AS pos, p_name AS nome_instituicao, 'Esteio' AS municipio, 'RS' AS uf, '' AS endereco FROM part)"
_GREEDY = "SELECT csv_ord, db_ord, tier FROM g WHERE db_ord IS NOT NULL"


@_add("match_tiers", duck.statement(duck.greedy_ctes(duck.keys_ctes(duck.REG, duck.TIERED)), _GREEDY))
def match_tiers(s, d):
    return matching.match(*_tiered_sides(s, d))


@_add("diff_greedy_contention", duck.statement(duck.greedy_ctes(duck.keys_ctes(_PARTS_REG, _PARTS_BAT)), _GREEDY))
def diff_greedy_contention(s, d):
    return matching.match(*_contention(s, d))


_START = "substring({0}, 1, 12)"
_LOOKUP = duck.statement(
    f"{duck.keys_ctes(duck.REG, duck.TIERED)}, a AS (SELECT k1, min(ord) AS d1 FROM rk WHERE k1 IS NOT NULL GROUP BY k1), b AS (SELECT k2, min(ord) AS d2 FROM rk WHERE k2 IS NOT NULL GROUP BY k2), "
    f"st AS (SELECT ord, {_START.format(duck.fold('nome'))} AS s FROM rk), pre AS (SELECT substring(s, 1, n) AS s, min(ord) AS d3 FROM (SELECT ord, s, unnest(range(1, length(s) + 1)) AS n FROM st WHERE s <> '') GROUP BY 1)",
    f"SELECT ord, CAST(CASE WHEN d1 IS NOT NULL THEN 1 WHEN d2 IS NOT NULL THEN 2 WHEN d3 IS NOT NULL THEN 3 END AS INTEGER) AS step, coalesce(d1, d2, d3) AS db_ord FROM bk LEFT JOIN a USING (k1) LEFT JOIN b USING (k2) LEFT JOIN pre ON pre.s = {_START.format(duck.fold('bk.nome'))}",
)


@_add("lookup_names", _LOOKUP)
def lookup_names(s, d):
    return matching.lookup(_tiered_sides(s, d)[0] if _tiered_sides.kept(s, d) else _named_tiered(s, d), _by_name(s, d)[1])


# comparison
@_once
def _diff(s, d, **kw):
    return diff.compare(domain.registry(s, d), domain.batch(s, d), registry_order="id", batch_order="pos", **({"partial": False} | kw))


@_add("diff_status", duck.statement(duck.diff_ctes(), "SELECT coalesce(ord, -1) AS ord, coalesce(id, -1) AS id, status FROM diff"))
def diff_status(s, d):
    return _diff(s, d).rows.select(F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("id", F.lit(-1)).alias("id"), "status")


@_add("diff_attributes", duck.statement(duck.diff_ctes(), "SELECT ord, id, diferencas FROM diff WHERE status = 'alterado'"))
def diff_attributes(s, d):
    return _diff(s, d).rows.where("status = 'alterado'").select("ord", "id", F.array_join("diferencas", " | ").alias("diferencas"))


_COUNTS = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}s_qtd" for x in diff.STATUSES)


@_add("diff_summary", duck.statement(duck.diff_ctes(), f"SELECT {_COUNTS}, (SELECT count(*) FROM bat) AS total_csv, (SELECT count(*) FROM reg) AS total_db, false AS is_parcial FROM diff"))
def diff_summary(s, d):
    return _diff(s, d).summary.select(*[f"{x}s_qtd" for x in diff.STATUSES], "total_csv", "total_db", "is_parcial")


@_add("diff_cascade", duck.statement(duck.diff_ctes(), "SELECT coalesce(ord, -1) AS ord, coalesce(id, -1) AS id, status FROM diff"))
def diff_cascade(s, d):
    return _diff(s, d, exact=False).rows.select(F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("id", F.lit(-1)).alias("id"), "status")


@_once
def _hard_diff(s, d):
    return diff.compare(domain.registry(s, d), domain.hard(s, d), registry_order="id", batch_order="pos", partial=False)


@_add("diff_tiers_status", duck.statement(duck.diff_ctes(hard=True), "SELECT coalesce(ord, -1) AS ord, coalesce(nullif(id, 0), -1) AS id, status FROM diff"))
def diff_tiers_status(s, d):
    """The comparison of a batch that needs every tier, the fallback and all steps of the audit.  An id of 0 counts as none."""
    return _hard_diff(s, d).rows.select(F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("id", F.lit(-1)).alias("id"), "status")


@_add("diff_tiers_changes", duck.statement(duck.diff_ctes(hard=True), "SELECT ord, nullif(id, 0) AS id, diferencas FROM diff WHERE status = 'alterado'"))
def diff_tiers_changes(s, d):
    return _hard_diff(s, d).rows.where("status = 'alterado'").select("ord", "id", F.array_join("diferencas", " | ").alias("diferencas"))


@_add("inactivated", duck.statement(duck.diff_ctes(), "SELECT id FROM diff WHERE status = 'inativado'"))
def inactivated(s, d):
    return _diff(s, d).rows.where("status = 'inativado'").select("id")


@_add("reactivated", duck.statement(duck.diff_ctes(), "SELECT id FROM diff WHERE status = 'reativado'"))
def reactivated(s, d):
    return _diff(s, d).rows.where("reativar").select("id")


@_add("partial_lock", duck.statement(f"{duck.REG}, {duck.BAT}", "SELECT (SELECT count(*) FROM bat WHERE pos > 10000000) < 0.8 * (SELECT count(*) FROM reg) AS is_parcial, CASE WHEN (SELECT count(*) FROM bat WHERE pos > 10000000) < 0.8 * (SELECT count(*) FROM reg) THEN 0 ELSE (SELECT count(*) FROM reg WHERE ativo = 1) END AS inativados_qtd, (SELECT count(*) FROM bat WHERE pos > 10000000) AS total_csv"))
def partial_lock(s, d):
    """A load of one kind of institution only."""
    out = diff.compare(domain.registry(s, d), domain.batch(s, d).where("pos > 10000000"), registry_order="id", batch_order="pos")
    return out.summary.select("is_parcial", "inativados_qtd", "total_csv")


# audit
def _fresh(b):
    return b.select("ord", "nome", _c("muni").alias("municipio"), _c("key_uf").alias("uf"), "endereco", "dependencia_adm", *[x for x in ("placed",) if x in b.columns])


@_once
def _audit_sides(s, d):
    b, r = _sides(s, d)
    return cut_all(audit.new_side(_fresh(b)), audit.audit_side(r))


#: What only the cleaning of names gives.
_NAMED = ("core", "tokens", "full_key", "k1", "k2", "k3", "k4", "k7")


@_once
def _placed_sides(s, d):
    """``_audit_sides`` without what needs cleaned names."""
    b, r = cut_all(*[df.drop(*_NAMED, "k5", "k6") for df in (with_batch_keys(normalize_columns(domain.batch(s, d), "pos")), with_registry_keys(normalize_columns(domain.registry(s, d), "id")))])
    sides = audit.new_side(_fresh(b)), audit.audit_side(r.withColumn("core", F.lit("")))
    return cut_all(*[x.drop("core") for x in sides])


def _by_place(s, d):
    """Sides of the audit with the places and telling words: the whole ones if their keys are kept already."""
    return _audit_sides(s, d) if _sides.kept(s, d) else _placed_sides(s, d)


_AUDIT = f"{duck.keys_ctes()}, {duck.audit_ctes('bk')}"
for _name, _f in (("cep", audit.by_code), ("street", audit.by_street)):
    _add(f"audit_{_name}", duck.statement(_AUDIT, f"SELECT csv_ord, db_ord FROM a_{_name}"))(lambda s, d, f=_f: f(*_by_place(s, d)))


@_add("audit_core", duck.statement(_AUDIT, "SELECT csv_ord, db_ord FROM a_core"))
def audit_core(s, d):
    b, r = _by_name(s, d)
    return audit.by_core(audit.new_side(_fresh(b)), r)


@_add("audit_words", duck.statement(_AUDIT, f"SELECT x.ord AS csv_ord, y.ord AS db_ord FROM x JOIN y ON x.muni_norm = y.muni_norm AND len(list_intersect(x.w, y.w)) >= 2 AND {duck.AUDIT_GUARD}"))
def audit_words(s, d):
    """All pairs."""
    return audit.pairs_by_words(*_by_place(s, d))


@_add("audit_match", duck.statement(_AUDIT, "SELECT csv_ord, db_ord FROM au"))
def audit_match(s, d):
    return audit.audit_match(*_audit_sides(s, d))


_OWNERSHIP = duck.fold("nome_instituicao")


@_add("audit_guards", duck.statement(f"{duck.REG}, {duck.BAT}", f"SELECT pos, CASE WHEN {_OWNERSHIP} <> '' THEN regexp_matches({_OWNERSHIP}, 'publica|federal|estadual|municipal') END AS publica FROM bat"))
def audit_guards(s, d):
    """Whether a text names public ownership, over the batch's names, some of which do."""
    return domain.batch(s, d).select("pos", audit.public(_c("nome_instituicao")).alias("publica"))


# course sets
def _course_sides(s, d):
    own = domain.offers(s, d).withColumn("half", F.when(_c("course_id") % 3 == 0, "old").when(_c("course_id") % 3 == 1, "new").otherwise("both"))
    sets = own.groupBy(_c("inst_id").alias("id")).agg(F.collect_set(F.when(_c("half") != "old", _c("course_id").cast("string"))).alias("cursos"), F.collect_set(F.when(_c("half") != "new", _c("course_id").cast("string"))).alias("cursos_db"))
    return sets.withColumn("nome", F.lit("x"))


_SETS = f"{_OFFERS}, o AS (SELECT DISTINCT inst_id, course_id FROM offers)"
_KIND = {"course_added": ("Nova Oferta", "course_id % 3 = 1"), "course_closed": ("Encerrado", "course_id % 3 = 0")}
for _name, (_tipo, _where) in _KIND.items():
    _add(_name, duck.statement(_SETS, f"SELECT inst_id AS id, CAST(course_id AS VARCHAR) AS curso FROM o WHERE {_where}"))(lambda s, d, t=_tipo: course_changes(_course_sides(s, d), False).where(_c("tipo") == t).select("id", "curso"))


@_add("course_kept", duck.statement(_SETS, "SELECT inst_id AS id, CAST(course_id AS VARCHAR) AS curso FROM o WHERE course_id % 3 = 2"))
def course_kept(s, d):
    return _course_sides(s, d).select("id", F.explode(F.array_intersect("cursos", "cursos_db")).alias("curso"))


@_add("course_stats", duck.statement(_SETS, "SELECT count(*) FILTER (course_id % 3 = 1) AS novos_cursos_qtd, count(*) FILTER (course_id % 3 = 0) AS cursos_descontinuados_qtd, count(*) FILTER (course_id % 3 = 2) AS cursos_mantidos_qtd FROM o"))
def course_stats(s, d):
    df = _course_sides(s, d)
    return course_counts(df, df.limit(0), False)


@_add("course_distinct", duck.statement(_OFFERS, "SELECT count(DISTINCT course_id) AS n FROM offers"))
def course_distinct(s, d):
    return domain.offers(s, d).agg(F.count_distinct("course_id").alias("n"))


# maintenance
def _lines(s, d):
    return read(s, d, "lineitem").select(_c("l_orderkey").alias("id"), _c("l_linenumber").alias("linha"), _c("l_returnflag").alias("nome_instituicao"))


@_add("dup_ids_top50", "SELECT l_orderkey AS id, count(*) AS total FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY total DESC, id LIMIT 50")
def dup_ids_top50(s, d):
    return quality.duplicate_ids(_lines(s, d))


@_add("dup_preview", "SELECT l_orderkey AS id, count(*) AS total, min(l_returnflag) AS exemplo FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY total DESC, id LIMIT 20")
def dup_preview(s, d):
    return quality.duplicate_preview(_lines(s, d))


@_add("dup_excess", "SELECT count(*) AS ids_duplicados, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excesso, count(*) = 0 AS unico FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def dup_excess(s, d):
    return quality.excess_rows(_lines(s, d))


@_add("dedup_first", "SELECT l_orderkey AS id, min(l_linenumber) AS linha FROM lineitem GROUP BY l_orderkey")
def dedup_first(s, d):
    return quality.dedupe_ids(_lines(s, d), ["linha"])[0].select("id", "linha")


@_add("dedup_removed", "SELECT id, linha FROM (SELECT l_orderkey AS id, l_linenumber AS linha, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r > 1")
def dedup_removed(s, d):
    return quality.dedupe_ids(_lines(s, d), ["linha"])[1].select("id", "linha")


@_add("sanitize_needed", duck.statement(f"{duck.REG}, {duck.BAT}, {duck.parse_ctes('bat', 'x', 'endereco', 'municipio', 'uf')}", "SELECT * FROM (SELECT pos AS id, coalesce(nullif(p_municipio, ''), municipio) AS novo_municipio, coalesce(nullif(p_uf, ''), uf) AS novo_uf, coalesce(p_cep, '') AS novo_cep, municipio AS m, uf AS u FROM x) WHERE novo_municipio <> m OR contains(m, ' - ') OR regexp_matches(m, ' (RJ|SP|MG) ') OR novo_uf <> u OR novo_cep <> ''").replace("SELECT * FROM (SELECT pos AS id", "SELECT id, novo_municipio, novo_uf, novo_cep FROM (SELECT pos AS id"))
def sanitize_needed(s, d):
    df = domain.batch(s, d).withColumn("cep", F.lit("")).withColumnRenamed("pos", "id")
    return quality.sanitized(df).select("id", "novo_municipio", "novo_uf", "novo_cep")


@_add("active_counts", duck.statement(duck.REG, "SELECT count(*) FILTER (ativo = 1) AS instituicoes, (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS cursos FROM reg"))
def active_counts(s, d):
    return quality.active_counts(instituicoes=domain.registry(s, d), cursos=read(s, d, "part").select((_c("p_size") % 2 == 0).cast("int").alias("ativo")))


@_add("names_present", duck.statement(duck.REG, f"SELECT nome, (SELECT bool_or(contains({duck.fold('nome_instituicao')}, {duck.fold('nome')})) FROM reg) AS presente FROM (VALUES ('Customer#000000007'), ('Escola Inexistente')) v(nome)"))
def names_present(s, d):
    return quality.present(domain.registry(s, d), ["Customer#000000007", "Escola Inexistente"])


@_add("latest_audit", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def latest_audit(s, d):
    return quality.latest(read(s, d, "events").select("event_id", "event_type"), "event_id")


@_add("sample_limit", "SELECT event_id FROM events ORDER BY event_id LIMIT 10")
def sample_limit(s, d):
    return search.page(read(s, d, "events").select("event_id"), ["event_id"], 1, 10)


@_add("page", "SELECT event_id, event_type FROM events ORDER BY event_type, event_id LIMIT 20 OFFSET 40")
def page(s, d):
    return search.page(read(s, d, "events").select("event_id", "event_type"), ["event_type", "event_id"], 3, 20)


@_once
def _event_pages(s, d):
    return indexes.page_index(read(s, d, "events").select("event_id", "event_type"), ["event_type", "event_id"], rows_in_range=500)


@_add("page_index", "(SELECT 3 AS pagina, event_id, event_type FROM events ORDER BY event_type, event_id LIMIT 20 OFFSET 40) UNION ALL (SELECT 37, event_id, event_type FROM events ORDER BY event_type, event_id LIMIT 20 OFFSET 720)")
def page_index(s, d):
    """Pages from the ranges that hold them."""
    own = _event_pages(s, d)
    return own.page(3, 20).select(F.lit(3).alias("pagina"), "event_id", "event_type").unionByName(own.page(37, 20).select(F.lit(37).alias("pagina"), "event_id", "event_type"))


@_add("page_seek", "SELECT event_id, event_type FROM events WHERE (event_type, event_id) > (SELECT (event_type, event_id) FROM events ORDER BY event_type, event_id LIMIT 1 OFFSET 777) ORDER BY event_type, event_id LIMIT 50")
def page_seek(s, d):
    """The rows after the last one of a page."""
    own = _event_pages(s, d)
    last = own.page(778, 1).first()
    return own.after((last.event_type, last.event_id), 50)


@_add("search_index", duck.statement(duck.REG, "SELECT id, nome_instituicao FROM reg WHERE contains(lower(concat_ws(' ', nome_instituicao, municipio, endereco)), '7, centro, são')"))
def search_index(s, d):
    """A search that reads the postings of the query's trigrams and verifies the hits."""
    text = F.concat_ws(" ", "nome_instituicao", "municipio", "endereco")
    return indexes.text_index(domain.registry(s, d), "id", text).containing("7, Centro, São").select("id", "nome_instituicao")


@_add("search_both", "SELECT id, nome, 'banco' AS origem FROM (SELECT p_partkey AS id, p_name AS nome FROM part) WHERE contains(lower(concat_ws(' ', CAST(id AS VARCHAR), nullif(nome, ''))), '1') AND contains(lower(nome), 'a') UNION ALL SELECT id, nome, 'raspagem' FROM (SELECT s_suppkey AS id, s_name AS nome FROM supplier) WHERE contains(lower(concat_ws(' ', CAST(id AS VARCHAR), nullif(nome, ''))), '1') AND contains(lower(nome), 'a')")
def search_both(s, d):
    a = read(s, d, "part").select(_c("p_partkey").alias("id"), _c("p_name").alias("nome"))
    b = read(s, d, "supplier").select(_c("s_suppkey").alias("id"), _c("s_name").alias("nome"))
    return search.search(a, b, "1", ["id", "nome"], filters={"nome": "A"})


@_add("prefix_match", f"SELECT p_partkey AS id FROM part WHERE starts_with({duck.fold('p_name')}, substring({duck.fold("(SELECT p_name FROM part ORDER BY p_partkey LIMIT 1)")}, 1, 12))")
def prefix_match(s, d):
    parts = read(s, d, "part")
    head = parts.orderBy("p_partkey").limit(1).select(F.substring(fold(_c("p_name")), 1, 12)).scalar()
    return parts.where(F.startswith(fold(_c("p_name")), head)).select(_c("p_partkey").alias("id"))


# synchronisation
@_once
def _plan(s, d):
    return cut(sync.actions(_diff(s, d).rows))


@_add("sync_plan", duck.statement(duck.diff_ctes(), "SELECT coalesce(id, -1) AS id, coalesce(ord, -1) AS ord, CASE status WHEN 'novo' THEN 'insert' WHEN 'inativado' THEN 'deactivate' ELSE 'update' END AS action FROM diff WHERE status <> 'mantido'"))
def sync_plan(s, d):
    return _plan(s, d).select(F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("ord", F.lit(-1)).alias("ord"), "action")


_BASE = ids.EPOCH_MS + 1000


@_add("sync_snapshot", duck.statement(duck.diff_ctes(), f"SELECT r.id, CASE WHEN x.status = 'inativado' THEN 0 WHEN x.status IN ('alterado', 'reativado') THEN 1 ELSE r.ativo END AS ativo FROM reg r LEFT JOIN (SELECT id, max(status) AS status FROM diff WHERE id IS NOT NULL GROUP BY id) x ON r.id = x.id UNION ALL SELECT ((1000 + ((row_number() OVER (ORDER BY ord) - 1) // 4096)) << 22) | (1 << 17) | (1 << 12) | ((row_number() OVER (ORDER BY ord) - 1) % 4096), 1 FROM diff WHERE status = 'novo'"))
def sync_snapshot(s, d):
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    return sync.apply(domain.registry(s, d), _plan(s, d), now, _BASE).select("id", "ativo")


_UPDATED = "upd AS (SELECT id, nome, CASE WHEN d_ativo = 0 THEN muni ELSE m END AS municipio, CASE WHEN d_ativo = 0 THEN kuf ELSE u END AS uf, CASE WHEN d_ativo = 0 THEN coalesce(nullif(cep_val, ''), p_cep, '') ELSE cc END AS cep, CASE WHEN d_ativo = 0 THEN endereco ELSE e_new END AS endereco FROM jg WHERE d_ativo = 0 OR len(d) > 0)"
_NOW = ", ".join(f"coalesce(nullif(x.{x}, ''), r.{y}) AS {y}" for x, y in (("nome", "nome_instituicao"), ("municipio", "municipio"), ("uf", "uf"), ("cep", "cep"), ("endereco", "endereco")))


@_add("sync_attributes", duck.statement(f"{duck.diff_ctes()}, {_UPDATED}", f"SELECT r.id, {_NOW} FROM reg r LEFT JOIN upd x ON r.id = x.id"))
def sync_attributes(s, d):
    """The attributes of the registry's rows after the plan: filled values of updates replace old ones."""
    reg = domain.registry(s, d)
    after = sync.apply(reg, _plan(s, d), F.lit(datetime(2024, 1, 1)).cast("timestamp"), _BASE)
    return after.join(reg.select("id"), "id", "left_semi").select("id", "nome_instituicao", "municipio", "uf", "cep", "endereco")


@_add("offers_insert_ignore", duck.statement(_OFFERS, "SELECT DISTINCT inst_id, course_id FROM offers WHERE course_id % 2 = 1"))
def offers_insert_ignore(s, d):
    own = domain.offers(s, d)
    return sync.new_offers(own, own.where("course_id % 2 = 0"))


@_add("soft_delete", duck.statement(duck.REG, "SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE ativo END AS ativo FROM reg"))
def soft_delete(s, d):
    reg = domain.registry(s, d)
    return sync.soft_delete(reg, reg.where("id % 4 = 0").select("id")).select("id", "ativo")


@_add("audit_row", duck.statement(duck.diff_ctes(), "SELECT CAST(count(*) FILTER (status = 'novo') AS INTEGER) AS total_inseridos, CAST(count(*) FILTER (status IN ('alterado', 'reativado')) AS INTEGER) AS total_atualizados, CAST(count(*) FILTER (status = 'inativado') AS INTEGER) AS total_inativados, 'a@b' AS usuario_email FROM diff"))
def audit_row(s, d):
    return sync.audit_record(_plan(s, d), 7, "a@b", "127.0.0.1", base_ms=_BASE).select("total_inseridos", "total_atualizados", "total_inativados", "usuario_email")


@_once
def _database(s, d):
    db = Database.embedded(s)
    dbsync.load(s, db, "registry", domain.registry(s, d), dbsync.REGISTRY, ("id",))
    return db


_LOADED = "id, nome_instituicao, municipio, uf, cep, endereco, ativo"


@_add("jdbc_registry", duck.statement(duck.REG, f"SELECT {_LOADED} FROM reg"))
def jdbc_registry(s, d):
    """The registry from a database, in ranges of its ids."""
    return dbsync.registry_of(s, _database(s, d)).select(*database.REGISTRY_COLUMNS)


@_add("jdbc_active", duck.statement(duck.REG, "SELECT id, uf, municipio FROM reg WHERE ativo = 1 AND uf = 'SP'"))
def jdbc_active(s, d):
    """Projected and filtered by the database."""
    return database.read_table(s, "registry", ("id", "uf", "municipio"), "ativo = 1 and uf = 'SP'", db=_database(s, d))


@_once
def _synced(s, d):
    db = Database.embedded(s)
    dbsync.load(s, db, "registry", domain.registry(s, d), dbsync.REGISTRY, ("id",))
    own = domain.offers(s, d)
    dbsync.load(s, db, "offers", own.where("course_id % 2 = 0").select("inst_id", "course_id").distinct(), own.select("inst_id", "course_id").schema, ("inst_id", "course_id"))
    dbsync.apply(s, db, _plan(s, d), own, user=(7, "a@b", "127.0.0.1"), base_ms=_BASE)
    return db


def _like_query(name: str, other: str):
    """A query that must give what another gives by another way."""
    return _add(name, _SQL[other])


@_like_query("jdbc_sync", "sync_snapshot")
def jdbc_sync(s, d):
    """The registry after a staged merge in one transaction."""
    return dbsync.registry_of(s, _synced(s, d)).select("id", "ativo")


@_like_query("jdbc_sync_attributes", "sync_attributes")
def jdbc_sync_attributes(s, d):
    after = dbsync.registry_of(s, _synced(s, d))
    return after.join(domain.registry(s, d).select("id"), "id", "left_semi").select("id", "nome_instituicao", "municipio", "uf", "cep", "endereco")


@_like_query("jdbc_audit_log", "audit_row")
def jdbc_audit_log(s, d):
    return database.read_table(s, "audit_log", ("total_inseridos", "total_atualizados", "total_inativados", "usuario_email"), db=_synced(s, d))


@_add("jdbc_offers", duck.statement(_OFFERS, "SELECT DISTINCT inst_id, course_id FROM offers"))
def jdbc_offers(s, d):
    return database.read_table(s, "offers", ("inst_id", "course_id"), partition_column="inst_id", db=_synced(s, d))


@_add("snowflake_ids", f"SELECT event_id, (({_BASE - ids.EPOCH_MS} + ((row_number() OVER (ORDER BY event_id) - 1) // 4096)) << 22) | (1 << 17) | (1 << 12) | ((row_number() OVER (ORDER BY event_id) - 1) % 4096) AS id FROM events")
def snowflake_ids(s, d):
    return ids.assign(read(s, d, "events").select("event_id"), "event_id", base_ms=_BASE)


# reports
@_add("report_new", duck.statement(f"{duck.diff_ctes()}, n AS (SELECT b.* FROM bk b JOIN diff f ON b.ord = f.ord WHERE f.status = 'novo')", "SELECT 'NOVO' AS snowflake_id, nome AS nome_instituicao, endereco, muni AS municipio, kuf AS uf FROM n"))
def report_new(s, d):
    return report.new_report(_diff(s, d).rows).select("snowflake_id", "nome_instituicao", "endereco", "municipio", "uf")


@_add("report_changed", duck.statement(duck.diff_ctes(), "SELECT id AS snowflake_id, diferencas AS diferencas_detectadas FROM diff WHERE status = 'alterado'"))
def report_changed(s, d):
    return report.changed_report(_diff(s, d).rows).select("snowflake_id", "diferencas_detectadas")


@_add("report_inactive", duck.statement(duck.diff_ctes(), "SELECT r.id AS snowflake_id, r.nome_instituicao, r.municipio, r.uf, r.cep, 'Inativado (ativo=0)' AS status_migracao FROM reg r JOIN diff f ON r.id = f.id WHERE f.status = 'inativado'"))
def report_inactive(s, d):
    return report.inactive_report(_diff(s, d).rows).select("snowflake_id", "nome_instituicao", "municipio", "uf", "cep", "status_migracao")


@_add("report_courses", duck.statement(_SETS, "SELECT inst_id AS snowflake_id, 'x' AS nome_instituicao, CASE WHEN course_id % 3 = 1 THEN 'Nova Oferta' ELSE 'Encerrado' END AS tipo_alteracao, CAST(course_id AS VARCHAR) AS nome_curso FROM o WHERE course_id % 3 <> 2"))
def report_courses(s, d):
    return report.course_report(course_changes(_course_sides(s, d), False))


@_add("ascii_table", "SELECT * FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS n, rpad(substring(CAST(p_partkey AS VARCHAR), 1, 8), 8, ' ') || ' | ' || rpad(substring(p_name, 1, 15), 15, ' ') AS linha FROM part ORDER BY p_partkey LIMIT 50) UNION ALL SELECT 51, '... e mais ' || (count(*) - 50) FROM part HAVING count(*) > 50")
def ascii_table(s, d):
    return report.ascii_table(read(s, d, "part"), [("p_partkey", 8), ("p_name", 15)], ["p_partkey"])


def _scratch(s: SparkSession, name: str) -> str:
    """A folder in the shared one that ``cut`` uses."""
    cut(s.range(1))
    return f"{s.sparkContext.getCheckpointDir()}/{name}-{os.getpid()}"


@_add("csv_roundtrip", "SELECT doc_id, nullif(text, '') AS text, lang FROM documents")
def csv_roundtrip(s, d):
    path = _scratch(s, "csv")
    files.write_csv(read(s, d, "documents").select("doc_id", "text", "lang"), path)
    return files.read_csv(s, path, "doc_id LONG, text STRING, lang STRING").select("doc_id", filled(_c("text")).alias("text"), "lang")


@_add("csv_versioned", "SELECT n_nationkey, n_name FROM nation")
def csv_versioned(s, d):
    folder = _scratch(s, "versioned")
    files.write_versioned(read(s, d, "nation").select("n_nationkey", "n_name"), folder, datetime(2024, 1, 1))
    return files.rows_or_newest(None, s, [f"{folder}/latest", f"{folder}/none"]).select(_c("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@_add("relations_missing", duck.statement(_OFFERS, "SELECT DISTINCT inst_id AS inst_snowflake_id, course_id AS course_snowflake_id FROM offers"))
def relations_missing(s, d):
    """The pairs of a file and of one that isn't there."""
    path = _scratch(s, "relations-one")
    files.write_csv(domain.offers(s, d).select(_c("inst_id").alias("inst_snowflake_id"), _c("course_id").alias("course_snowflake_id")).distinct(), path)
    return files.read_relations(s, path).unionByName(files.read_relations(s, f"{d}/no-such-file.csv"))


@_add("relations_scan", duck.statement(_OFFERS, "SELECT inst_id AS inst_snowflake_id, course_id AS course_snowflake_id FROM offers WHERE pos < (SELECT min(pos) FROM offers WHERE course_id % 7 = 0 AND pos > (SELECT max(pos) // 2 FROM offers))"))
def relations_scan(s, d):
    """Pairs up to the first bad line of files in order."""
    path = _scratch(s, "relations-scan")
    own = domain.offers(s, d)
    half = own.agg(F.expr("max(pos) div 2").alias("half"))
    bad = (_c("course_id") % 7 == 0) & (_c("pos") > _c("half"))
    own.join(F.broadcast(half)).select("pos", F.when(bad, "?").otherwise(F.concat_ws(";", "inst_id", "course_id")).alias("value")).orderBy("pos").select("value").write.mode("overwrite").text(path)
    return scan.scan_relations(s, path, header=False)


@_add("institutions_scan", "SELECT c_custkey AS snowflake_id, c_name AS nome_instituicao, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS dependencia_adm, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE rpad('x', CAST(500 + c_custkey % 11 AS INTEGER), 'x') END AS endereco FROM customer")
def institutions_scan(s, d):
    """Fields up to the first empty one."""
    path = _scratch(s, "institutions-scan")
    blank = F.when(_c("c_mktsegment") != "BUILDING", _c("c_mktsegment")).otherwise("")
    lines = F.concat_ws(";", _c("c_custkey").cast("string"), "c_name", blank, F.rpad(F.lit("x"), (500 + _c("c_custkey") % 11).cast("int"), "x"))
    read(s, d, "customer").select(lines.alias("value")).write.mode("overwrite").text(path)
    return scan.scan_institutions(s, path, header=False).select("snowflake_id", "nome_instituicao", "dependencia_adm", "endereco")


@_add("relations_read", duck.statement(_OFFERS, "SELECT DISTINCT inst_id AS inst_snowflake_id, course_id AS course_snowflake_id FROM offers WHERE course_id % 10 <> 3"))
def relations_read(s, d):
    """Pairs from a file some of whose lines lack the course."""
    path = _scratch(s, "relations")
    pairs = domain.offers(s, d).select(_c("inst_id").alias("inst_snowflake_id"), F.when(_c("course_id") % 10 != 3, _c("course_id")).alias("course_snowflake_id")).distinct()
    files.write_csv(pairs, path)
    return files.read_relations(s, path)


@_add("xlsx_cells", "SELECT * FROM (SELECT 'Nações' AS folha, CAST(1 AS BIGINT) AS linha, 'n_nationkey' AS a, 'n_name' AS b UNION ALL SELECT 'Nações', row_number() OVER (ORDER BY n_nationkey) + 1, CAST(n_nationkey AS VARCHAR), n_name FROM nation)")
def xlsx_cells(s, d):
    with tempfile.TemporaryDirectory() as folder:  # the workbook is the driver's own file
        path = os.path.join(folder, "x.xlsx")
        report.write_xlsx(path, {"Nações": read(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")})
        rows = [(name, i, *cells) for name, lines in report.read_xlsx(path).items() for i, cells in enumerate(lines, 1)]
    return s.createDataFrame(rows, "folha string, linha long, a string, b string")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: the whole comparison of a perturbed batch with the registry."""
    return _diff(spark, "/root/testdata/sf0.001").rows


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
