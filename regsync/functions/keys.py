"""Match keys of registry and batch rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .address import clean_municipality, normalize_municipality, split_municipality, with_location, with_parsed_address
from .base import built_once, filled, first_filled, fold, strip
from .text import core_name, expand, name_tokens, natural_key

#: Tiers in the order in which a row tries them, and whether the first free candidate is taken or only a sole one.
TIERS = (("k1", "first"), ("k2", "first"), ("k3", "sole"), ("k4", "sole"), ("k5", "first"), ("k6", "first"), ("k7", "sole"))
#: Names and addresses that say nothing.
NO_NAME = ("", "sem nome", "não informado", "n/i", "none")
NO_ADDRESS = ("", "não informado", "n/i", "none")


def state_code(uf: Column) -> Column:
    return F.substring(F.upper(fold(uf)), 1, 2)


def _key(*parts: Column, when: Column | None = None) -> Column:
    ok = F.lit(True) if when is None else when
    for p in parts:
        ok = ok & (p != "")
    return F.when(ok, F.concat_ws("_", *parts))


@built_once
def _cleaned() -> dict[str, Column]:
    return {"muni_norm": normalize_municipality(F.col("muni")), "name_clean": expand(F.col("nome"))}


@built_once
def _made_of() -> dict[str, Column]:
    c = F.col
    return {"core": core_name(c("nome"), c("name_clean")), "tokens": name_tokens(c("name_clean")), "cep_val": first_filled(c("loc.cep"), c("ext_cep")), "num": c("loc.num"), "street": c("loc.street")}


@built_once
def _joined() -> dict[str, Column]:
    c, long_core = F.col, F.length("core") >= 5
    return {
        "k1": filled(c("full_key")),
        "k2": _key(c("core"), c("muni_norm"), c("uf2")),
        "k3": _key(c("core"), c("uf2"), when=long_core),
        "k4": _key(c("tokens"), c("uf2"), when=F.length("tokens") >= 6),
        "k5": _key(c("cep_val"), c("num"), c("uf2")),
        "k6": _key(c("street"), c("num"), c("muni_norm"), c("uf2")),
        "k7": _key(c("core"), when=long_core),
    }


def _with_keys(df: DataFrame, uf_in_key: bool, **known) -> DataFrame:
    c = F.col
    df = with_location(df.withColumns(_cleaned()), "loc", c("endereco"), c("muni"), c("uf2"), **known)
    df = df.withColumns(_made_of() | {"full_key": natural_key(c("nome"), c("muni_norm"), c("key_uf"), uf_in_key, c("name_clean"))})
    return df.withColumns(_joined()).drop("loc", "name_clean")


@built_once
def _registry_steps() -> tuple:
    c = F.col
    lacks = ((c("muni") == "") | (c("key_uf") == "")) & (c("endereco") != "")
    return (
        {"split": split_municipality(c("municipio"))},
        {"muni": c("split.muni"), "key_uf": first_filled(c("uf"), c("split.uf")), "ext_cep": F.coalesce("split.cep", F.lit(""))},
        tuple(F.when(lacks, c(x)) for x in ("endereco", "muni", "key_uf")),
        {"muni": F.when(c("muni") == "", clean_municipality(c("parsed.municipio"))).otherwise(c("muni")), "key_uf": first_filled(c("key_uf"), c("parsed.uf"))},
        {"uf2": state_code(c("key_uf"))},
    )


def with_registry_keys(registry: DataFrame, uf_in_key: bool = False) -> DataFrame:
    """A normalised registry with muni, uf2 (its state), keys k1 to k7 and what they are made of."""
    split, first, lacking, better, state = _registry_steps()
    df = with_parsed_address(registry.withColumns(split).withColumns(first), "parsed", *lacking)
    return _with_keys(df.withColumns(better).withColumns(state), uf_in_key).drop("split", "parsed")


@built_once
def _batch_steps() -> tuple:
    c = F.col
    nothing = F.lower("nome").isin(*NO_NAME) & F.lower("endereco").isin(*NO_ADDRESS)
    better = filled(c("parsed.municipio")).isNotNull() & ((c("muni") == "") | (F.length("a") > F.length("b")) | c("a").startswith(c("b")))
    return (
        {n: strip(c(n)) for n in ("nome", "endereco", "municipio")},
        ~nothing,
        {"split": split_municipality(c("municipio")), "uf_given": state_code(c("uf"))},
        {"muni": c("split.muni"), "key_uf": first_filled(c("uf_given"), c("split.uf")), "ext_uf": c("split.uf"), "ext_cep": F.coalesce("split.cep", F.lit(""))},
        {"parsed": F.when(c("endereco") != "", c("parsed")), "muni_first": c("muni"), "uf_first": c("key_uf")},
        {"a": fold(c("parsed.municipio")), "b": fold(c("muni"))},
        {"muni": F.when(better, c("parsed.municipio")).otherwise(c("muni")), "key_uf": first_filled(c("key_uf"), c("parsed.uf"))},
    )


def with_batch_keys(batch: DataFrame, uf_in_key: bool = False) -> DataFrame:
    """A normalised batch without the rows that have neither a name nor an address; with muni, uf2, keys k1 to k7 and ``placed``, the address parsed with muni and uf2."""
    stripped, something, split, first, parsed, folded, better = _batch_steps()
    df = batch.withColumns(stripped).where(something).withColumns(split).withColumns(first)
    df = with_parsed_address(df, "parsed", F.col("endereco"), F.col("muni"), F.col("key_uf")).withColumns(parsed)
    df = df.withColumns(folded).withColumns(better).withColumn("uf2", F.col("key_uf"))
    same = (F.col("muni") == F.col("muni_first")) & (F.col("uf2") == F.col("uf_first"))
    return _with_keys(df, uf_in_key, known=F.col("parsed"), same=same, parsed="placed").drop("split", "parsed", "a", "b", "muni_first", "uf_first")
