"""An address that was parsed with the same municipality and state isn't parsed again."""

from pyspark.sql import functions as F

from regsync.functions import address as A
from regsync.functions.keys import with_batch_keys
from regsync.queries import domain
from regsync.schemas import normalize_columns


def test_known_addresses_are_taken(spark):
    rows = [(0, "Rua A, 1, Centro, Natal RN", "Natal", "RN", True), (1, "Rua B, 2, Centro, Natal RN", "Natal", "RN", False), (2, "Rua C, 3, Centro, Natal RN", "Natal", "RN", None)]
    df = spark.createDataFrame(rows, "i int, a string, m string, u string, same boolean")
    given = F.struct(*[F.lit("known").alias(x) for x in A.PARTS])
    own = [F.col(x) for x in "amu"]
    got = {r.i: r.p for r in A.with_known_address(df, "p", *own, given, F.col("same")).collect()}
    want = {r.i: r.p for r in A.with_parsed_address(df, "p", *own).collect()}
    assert set(got[0]) == {"known"} and got[1] == want[1] and got[2] == want[2] and want[1].logradouro == "Rua B"


def test_placed_is_parsed_with_the_final_place(spark):
    """Also of rows whose address names another municipality than they give."""
    df = domain.hard(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([(-1, "Escola Um", "", "", "Rua A, 1, Centro, Olinda PE"), (-2, "Escola Dois", "São", "", "Rua B, 2, Centro, São Paulo SP"), (-3, "Escola Tres", "Natal 59000-000", "RN", "")], df.schema)
    keyed = with_batch_keys(normalize_columns(df.unionByName(odd), "pos")).localCheckpoint()
    c = F.col
    want = A.with_parsed_address(keyed, "want", c("endereco"), c("muni"), c("uf2")).localCheckpoint().where("endereco <> ''")
    assert want.count() > 100 and want.where(~c("want").eqNullSafe(c("placed"))).count() == 0
    assert keyed.where("ord = -2").first().muni == "São Paulo"
