"""The audit's queries by place don't clean names, and don't parse again what the keys have parsed."""

from pyspark.sql import functions as F

import __spark_entry__ as driver
from regsync import queries as registry
from regsync.operators import audit

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_same_rows_with_and_without_names(spark):
    known = driver.queries()
    alone = {}
    for name in ("audit_cep", "audit_street"):
        registry.forget()
        alone[name] = _rows(known[name](spark, SF))
        assert not any(key[0] in ("_sides", "_audit_sides") for key in registry._KEPT), name
    registry.forget()
    known["match_keys"](spark, SF)  # now the whole sides are kept, and used
    for name in alone:
        assert _rows(known[name](spark, SF)) == alone[name] and alone[name], name
    assert not any(key[0] == "_placed_sides" for key in registry._KEPT)
    registry.forget()


def test_a_parsed_address_is_taken(spark):
    """Where the municipality and state are those that it was parsed with; else the address is parsed."""
    hard = registry.domain.hard(spark, SF)
    odd = spark.createDataFrame([(-1, "Escola Um", "", "", "Rua A, 1, Centro, Olinda PE"), (-2, "Escola Dois", "Natal 59000-000", "RN", ""), (-3, "Escola Tres", " São Paulo", "sp", "Rua B, 2, Centro, São Paulo SP")], hard.schema)
    keyed = registry.with_batch_keys(registry.normalize_columns(hard.unionByName(odd), "pos")).localCheckpoint()
    fresh = registry._fresh(keyed)
    assert _rows(audit.new_side(fresh)) == _rows(audit.new_side(fresh.drop("placed")))
    told = fresh.where("ord > 0 and endereco <> ''").withColumn("placed", F.col("placed").withField("numero", F.lit("777")))
    assert {r.num for r in audit.new_side(told).select("num").distinct().collect()} == {"777"}
    other = told.withColumns({"municipio": F.concat(F.lit(" "), "municipio")})
    assert "777" not in {r.num for r in audit.new_side(other).select("num").distinct().collect()}
