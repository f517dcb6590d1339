"""Scalar functions on literal examples."""

import pytest
from pyspark.sql import functions as F

from regsync.functions import address as A
from regsync.functions import ids
from regsync.functions import text as X
from regsync.functions.base import fold, fold_exact


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_fold(spark):
    df = spark.createDataFrame([(" São José-1 ",), (None,), ("",), ("a.",), ("Nº ª",)], "t string")
    assert [r[0] for r in df.select(fold(F.col("t"))).collect()] == ["sao jose 1", "", "", "a ", "no a"]
    assert [r[0] for r in df.select(fold_exact(F.col("t"))).collect()] == ["sao jose 1", "", "", "a ", "no a"]


@pytest.mark.parametrize(
    ("name", "expanded"),
    [("E.E. Prof. Ana", "escola estadual professor ana"), ("Esc. Tec. Est. Sta Maria", "escola tecnica estadual santa maria"), ("", ""), (None, "")],
)
def test_expand(spark, name, expanded):
    assert one(spark, X.expand(F.col("n")), n=name) == expanded


def test_names(spark):
    n = F.col("n")
    key = X.natural_key(n, A.normalize_municipality(F.lit("Esteio")), F.lit(""))
    assert one(spark, key, n="Escola Técnica São José") == "escolatecnicasaojose_esteio"
    with_state = X.natural_key(n, A.normalize_municipality(F.lit("Esteio")), F.lit("RS"), uf_in_key=True)
    assert one(spark, with_state, n="Escola Técnica São José") == "escolatecnicasaojose_esteio_rs"
    assert one(spark, X.core_name(n), n="Escola Técnica São José") == "saojose"
    assert one(spark, X.richness(n), n="EE Ana Paula") == 1 + 3
    assert one(spark, X.distance_learning(n), n="Polo (EaD) Sul") is True
    assert one(spark, X.distance_learning(n), n=None) is False
    assert one(spark, X.sentinel(n), n=None) == X.MISSING


def test_codes_and_towns(spark):
    m = F.col("m")
    assert tuple(one(spark, A.split_municipality(m), m="Cuiabá MT - 78005-")) == ("Cuiabá", "MT", "78005")
    assert tuple(one(spark, A.split_municipality(m), m="Pedreiras MA - 65.72500")) == ("Pedreiras", "MA", "6572500")
    assert tuple(one(spark, A.split_municipality(m), m="Pedro II Pi - 64255000.")) == ("Pedro II", "PI", "64255000")
    assert tuple(one(spark, A.split_municipality(m), m=None)) == ("", None, None)
    assert one(spark, A.format_cep(m), m="90010000") == "90010-000"
    assert one(spark, A.is_cep(m), m="123") is False
    assert one(spark, A.is_municipality(m), m="Jardim") is True
    assert one(spark, A.is_municipality(m), m="Jardim América") is True
    assert one(spark, A.is_municipality(m), m="jardim america") is False
    assert one(spark, A.is_municipality(m), m="Sala 3") is False
    assert one(spark, A.normalize_municipality(m), m="Itapajé") == one(spark, A.normalize_municipality(m), m="Itapagé")
    assert one(spark, A.protect_municipality(F.lit("Pedro II"), m), m="Pedro") == "Pedro II"
    assert one(spark, A.is_roman(m), m="xix") is True
    assert one(spark, A.dedupe_address(m), m="Enida Sete, 5, CENTRO, Centro, Cx. Postal 12") == "Avenida Sete, 5, CENTRO"


def test_addresses(spark):
    rows = [(1, "RUA 24 DE MAIO, S/N, BAIRRO X, ESTEIO, RS", None, None), (2, "Avenida Brasil, 123, Sala 4, Centro, Porto Alegre RS - 90010-001", None, None), (3, "Rua A, 10, Centro, Pedro", "Pedro II", "PI"), (4, None, "Esteio", "rs"), (5, "", None, None)]
    df = spark.createDataFrame(rows, "i int, a string, m string, u string")
    out = A.with_location(A.with_parsed_address(df, "p", F.col("a"), F.col("m"), F.col("u")), "l", F.col("a"), F.col("m"), F.col("u")).orderBy("i").collect()
    assert tuple(out[0].p) == ("RUA 24 DE MAIO", "S/N", None, "BAIRRO X", "ESTEIO", "RS", None)
    assert tuple(out[1].p) == ("Avenida Brasil", "123", "Sala 4", "Centro", "Porto Alegre", "RS", "90010001")
    assert out[2].p.municipio == "Pedro II"
    assert tuple(out[3].p) == (None, None, None, None, "Esteio", "RS", None)
    assert set(out[4].p) == {None}
    assert [tuple(r.l) for r in out] == [("", "sn", "24 de maio"), ("90010001", "123", "brasil"), ("", "10", "a"), ("", "", ""), ("", "", "")]


def test_ids(spark):
    df = ids.assign(spark.range(10_000).repartition(7), "id", name="nova", base_ms=ids.EPOCH_MS + 5)
    values = [r.nova for r in df.orderBy("id").collect()]
    assert len(set(values)) == 10_000 and values == sorted(values) and max(values) < 2**63
    back = spark.createDataFrame([(values[5000],)], "v long").select(ids.unpack(F.col("v")).alias("u")).first().u
    assert (back.ms, back.sequence) == (ids.EPOCH_MS + 6, 5000 - 4096)
    assert ids.assign(spark.range(0)).count() == 0
