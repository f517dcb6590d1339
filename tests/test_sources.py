"""Files, the catalogue and the driver's contract."""

import json
from datetime import datetime
from urllib.error import HTTPError

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from regsync.operators import records
from regsync.sources import catalogue, database, files

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;b "c"\nd', [1, 2]), (2, None, [])], "id long, t string, l array<int>")
    files.write_csv(df, str(tmp_path / "x"), single=True)
    got = files.read_csv(spark, str(tmp_path / "x"), "id long, t string, l string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a;b "c"\nd', "[1,2]"), (2, None, "[]")]
    path = files.write_versioned(df, str(tmp_path / "v"), datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("ts=20240506_070809") and files.newest(spark, [str(tmp_path / "none"), path]) == path
    assert files.newest(spark, []) is None and files.read_relations(spark, str(tmp_path / "none")).count() == 0
    assert files.rows_or_newest(df, spark, []).count() == 2
    with pytest.raises(FileNotFoundError):
        files.rows_or_newest(df.limit(0), spark, [])
    assert files.rows_from_json(spark, [{"id": 1}], "id long, t string").first().t is None


def test_http_attempts():
    calls = []

    def fail(request, timeout):
        calls.append(timeout)
        raise OSError

    assert catalogue.get_json("http://x", open_=fail, sleep=calls.append) == (0, None) and calls == [10, 0.5, 10]

    def missing(request, timeout):
        raise HTTPError("http://x", 404, "", None, None)

    assert catalogue.get_json("http://x", open_=missing) == (404, None)
    assert catalogue.total_courses(None) == 215 and catalogue.total_courses({"catalogo": {"quantidadeCursos": 7}}) == 7
    assert catalogue.institutions_url("http://x/", "a é") == "http://x/a%20%C3%A9"


def test_catalogue_source(spark, tmp_path):
    (tmp_path / "b-1.json").write_text(json.dumps({"id": 1, "nome": "Técnico", "areasTecnologicas": [{"id": 3, "nome": "Saúde"}]}))
    (tmp_path / "b-2.json").write_text(json.dumps({"id": 2, "nome": ""}))
    urls = [f"file:{tmp_path}/a-{{key}}.json", f"file:{tmp_path}/b-{{key}}.json"]
    raw = catalogue.fetch(spark, urls, records.COURSE_JSON, first=1, last=4, partitions=2)
    rows = records.course_records(records.valid_courses(raw)).collect()
    assert [(r.id_original, r.nome_curso, r.eixo_tecnologico, r.carga_horaria) for r in rows] == [(1, "Técnico", "Saúde", "não informado")]
    (tmp_path / "i-x.json").write_text(json.dumps([{"nome": "A", "municipio": "Natal"}, {"nome": "B", "cidade": "Olinda"}]))
    inst = catalogue.fetch(spark, [f"file:{tmp_path}/i-{{key}}.json"], records.INSTITUTION_JSON, keys="x")
    assert sorted((r.nome_instituicao, r.municipio) for r in records.institution_records(inst).collect()) == [("A", "Natal"), ("B", "Olinda")]


def test_catalogue_accepts_courses_only(spark, tmp_path):
    (tmp_path / "a-1.json").write_text(json.dumps({"erro": "x"}))
    (tmp_path / "b-1.json").write_text(json.dumps({"id": 1, "nome": ""}))
    (tmp_path / "a-2.json").write_text(json.dumps([{"id": 2}]))
    urls = [f"file:{tmp_path}/a-{{key}}.json", f"file:{tmp_path}/b-{{key}}.json"]
    got = catalogue.fetch(spark, urls, records.COURSE_JSON, first=1, last=3, accept="course").collect()
    assert [(r.key, r.id) for r in got] == [("1", 1)]
    answers = {"b/cnct-api/version": (200, "1.2"), "b/cnct-api/home/": (200, {"catalogo": {"quantidadeCursos": 9}}), "c/cnct-api/home/": (200, [])}
    fetch = lambda url, timeout=0: answers.get(url, (0, None))
    assert catalogue.ping("b", fetch) == (True, "1.2") and catalogue.ping("c", fetch) == (False, None)
    assert catalogue.total_courses(catalogue.home("b", fetch)) == 9 and catalogue.home("c", fetch) is catalogue.home("d", fetch) is None
    assert catalogue.first_course(["x", "y"], lambda url: (200, {"id": 5} if url == "y" else {"z": 1})) == {"id": 5}


def test_unreachable_database(spark):
    assert database.connection_or_none(spark, "t") is None


QUICK = ["fold_text", "muni_clean", "address_parse", "offers_agg", "dup_excess", "course_stats", "snowflake_ids", "search_both", "first_by_name"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own = driver.queries()[name](spark, SF)
    cols = sorted(own.columns)
    other = con.sql(f"select {', '.join(cols)} from ({driver.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in own.select(*cols).collect()), key=key) == sorted(other, key=key)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_streaming(spark, tmp_path):
    from regsync import domain
    from regsync.streaming.progress import event, percent, stream_diff

    batch = domain.batch(spark, SF).limit(3).withColumn("pos", F.col("pos").cast("long"))
    batch.write.parquet(str(tmp_path / "in"))
    got = []
    q = stream_diff(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), lambda: domain.registry(spark, SF), lambda r, n: got.append((n, r.summary.first().inativados_qtd)), str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == [(0, 0)] and percent(1, 3) == 33.3 and event("fim", n=1) == 'data: {"tipo": "fim", "n": 1}\n\n'
