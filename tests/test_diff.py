"""Matching, comparison and synchronisation on small registries."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from regsync.functions.keys import TIERS
from regsync.operators import audit, matching
from regsync.plans import diff, report, sync

KEYS = [k for k, _ in TIERS]
REG = "id long, nome_instituicao string, municipio string, uf string, endereco string, ativo int, cursos array<string>, pos long"


def sequential(batch, registry):
    """The whole procedure over all rows at once, written apart from the operator."""
    used, out = set(), {}
    for b in batch:
        hit = None
        for k, policy in TIERS:
            free = [r["ord"] for r in registry if b[k] is not None and r[k] == b[k] and r["ord"] not in used]
            if free and (policy == "first" or len(free) == 1):
                hit = free[0]
                break
        if hit is None:
            bucket = lambda k: [r["ord"] for r in registry if b[k] is not None and r[k] == b[k]]  # noqa: B023, E731
            if bucket("k1"):
                hit = bucket("k1")[0]
            elif b["k2"] is not None:
                hit = (bucket("k2") or [None])[0]
            elif b["k5"] is not None:
                hit = (bucket("k5") or [None])[0]
        if hit is not None:
            used.add(hit)
            out[b["ord"]] = hit
    return out


SIDE = "ord long, " + ", ".join(f"{k} string" for k in KEYS)


@pytest.mark.parametrize(("seed", "values", "share", "small"), [(4, 9, 0.35, 10_000), (5, 9, 0.35, 0), (6, 30, 0.7, 20)])
def test_matching_equals_the_sequential_procedure(spark, monkeypatch, seed, values, share, small):
    """In one small group, in rounds to the end, and in both."""
    rng = random.Random(seed)
    side = lambda n, base: [{"ord": base + i} | {k: (f"{k}{rng.randrange(values)}" if rng.random() < share else None) for k in KEYS} for i in range(n)]
    batch, registry = side(25, 0), side(25, 1000)
    got = matching.match(spark.createDataFrame(batch, SIDE), spark.createDataFrame(registry, SIDE), small).toPandas()
    assert dict(zip(got.csv_ord, got.db_ord, strict=True)) == sequential(batch, registry) and got.csv_ord.is_unique


def test_greedy_equals_the_sequential_procedure():
    rng = random.Random(9)
    for trial in range(200):
        side = lambda n, base: [{"ord": base + i} | {k: (f"{k}{rng.randrange(1 + trial % 9)}" if rng.random() < 0.4 else None) for k in KEYS} for i in range(n)]  # noqa: B023, E731
        batch, registry = side(rng.randrange(30), 0), side(rng.randrange(30), 1000)
        got = matching.greedy(pd.DataFrame(batch, columns=["ord", *KEYS]), pd.DataFrame(registry, columns=["ord", *KEYS]))
        assert dict(zip(got.csv_ord, got.db_ord, strict=True)) == sequential(batch, registry)


def test_a_large_component_needs_no_group(spark):
    """One name on 5,000 rows of each side, other keys shared across: rounds of joins settle nearly all."""
    n = 5000
    row = lambda i, base: (base + i, "same", "town", "core", f"t{i % 50}", f"cep{i}", None, "core")
    batch, registry = ([row(i, base) for i in range(m)] for base, m in ((0, n + 10), (100_000, n)))
    rest = [(200_000 + i, f"own{i}", "town2", "core2", None, None, None, "core2") for i in range(n)]
    b, r = spark.createDataFrame(batch + [(50_000 + i, *x[1:]) for i, x in enumerate(rest)], SIDE), spark.createDataFrame(registry + rest, SIDE)
    got = matching.match(b, r, small=100).toPandas().sort_values("csv_ord")
    assert got.db_ord.tolist() == [*range(100_000, 100_000 + n), *[100_000] * 10, *range(200_000, 200_000 + n)] and set(got.tier[:n]) == {1} and set(got.tier[n : n + 10]) == {8}


def test_repeated_names_need_no_rounds(spark, monkeypatch):
    """120 components of rows that all share a name and stand at a later tier: a round of joins would settle one row of each."""
    monkeypatch.setattr(matching, "rounds", None)
    monkeypatch.setattr(matching, "GROUP", 100)
    names, copies = 120, 6
    row = lambda i, base, town: {"ord": base + i} | dict.fromkeys(KEYS) | {"k2": f"{town}{i % names}", "k3": f"core{i % names}", "k5": f"cep{i}", "k7": f"core{i % names}"}
    batch, registry = ([row(i, base, town) for i in range(names * copies)] for base, town in ((0, "other"), (10_000, "town")))
    got = matching.match(spark.createDataFrame(batch, SIDE), spark.createDataFrame(registry, SIDE), small=100).toPandas()
    assert dict(zip(got.csv_ord, got.db_ord, strict=True)) == sequential(batch, registry) and got.csv_ord.is_unique
    assert set(got.tier) == {3, 5}


def test_greedy_of_nothing():
    empty = pd.DataFrame(columns=["ord", *KEYS])
    assert len(matching.greedy(empty, empty)) == 0


@pytest.fixture(scope="module")
def result(spark):
    reg = [
        (1, "E.E. Prof. Ana", "Esteio", "RS", "Rua A, 10, Centro, Esteio RS", 1, ["1", "2"], 0),
        (2, "Colégio Itapagé do Norte", "Itapagé", "CE", "Rua B, 20, Centro, Itapagé CE", 1, [], 1),
        (3, "Centro Antigo Fechado", "Natal", "RN", "Rua C, 30, Centro, Natal RN", 1, ["9"], 2),
        (4, "Escola Dormente Azul", "Natal", "RN", "Rua D, 40, Centro, Natal RN", 0, None, 3),
    ]
    bat = [
        (None, "Escola Estadual Professor Ana", "Esteio", "RS", "Rua A, 10, Centro, Esteio RS", 1, ["2", "3"], 0),
        (None, "Colégio Itapagé do Norte", "Itapajé", "CE", "Rua B, 20, Centro, Itapajé CE", 1, [], 1),
        (None, "Escola Dormente Azul", "Natal", "RN", "Rua D, 40, Centro, Natal RN", 1, [], 2),
        (None, "Instituto Totalmente Novo", "Olinda", "PE", "Rua Z, 99, Centro, Olinda PE", 1, ["7"], 3),
        (None, "N/I", "", "", "não informado", 1, [], 4),
    ]
    return diff.compare(spark.createDataFrame(reg, REG), spark.createDataFrame(bat, REG), registry_order="pos", batch_order="pos")


def test_statuses(result):
    got = {(r.ord, r.status): r for r in result.rows.collect()}
    assert set(got) == {(0, "alterado"), (1, "alterado"), (2, "reativado"), (3, "novo"), (None, "inativado")}
    assert got[(0, "alterado")].id == 1 and got[(0, "alterado")].diferencas == ["nome_instituicao: 'E.E. Prof. Ana' ➔ 'Escola Estadual Professor Ana'"]
    assert got[(1, "alterado")].id == 2 and got[(3, "novo")].id is None
    assert got[(None, "inativado")].id == 3
    s = result.summary.first()
    assert (s.total_csv, s.total_db, s.is_parcial, s.cursos_unicos_csv_qtd) == (5, 4, False, 3)
    assert (s.novos_cursos_qtd, s.cursos_descontinuados_qtd, s.cursos_mantidos_qtd) == (2, 1, 1)
    assert {(r.id, r.tipo, r.curso) for r in result.course_details.collect()} == {(1, "Nova Oferta", "3"), (1, "Encerrado", "1")}


def test_sync_and_reports(spark, result, tmp_path):
    plan = sync.actions(result.rows)
    assert {r.action: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()} == {"insert": 1, "update": 3, "deactivate": 1}
    reg = spark.createDataFrame([(i, f"n{i}", 1 if i < 4 else 0) for i in range(1, 5)], "id long, nome_instituicao string, ativo int")
    new = {r.id: r for r in sync.apply(reg, plan, base_ms=1704067200001).collect()}
    assert new[1].nome_instituicao == "Escola Estadual Professor Ana" and new[3].ativo == 0 and new[4].ativo == 1 and len(new) == 5
    paths = report.export(result.rows, result.course_details, str(tmp_path / "out"))
    sheets = report.read_xlsx(paths["diff_relatorio_completo"])
    assert list(sheets) == list(report.SHEETS) and sheets["Novos"][1][0] == "NOVO"
    text = report.diagnosis(result.summary, result.rows, result.course_details)
    assert "Modo de Importação: COMPLETA (Carga Nacional)" in text and "Instituto Totalmente Novo" in text and "(INSERT): 1\n" in text
    assert [line for line in text.split("\n") if line in [x[0] for x in report.SECTIONS]] == [x[0] for x in report.SECTIONS]
    none = report.section(2, report.inactive_report(result.rows.limit(0)), ["snowflake_id"]).collect()
    assert [r.linha for r in none] == [report.SECTIONS[2][1]]
    assert [report.column_letters(i) for i in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_partial_load_inactivates_nothing(spark):
    reg = spark.createDataFrame([(i, f"Escola Número {w}", "Natal", "RN", "", 1, None, i) for i, w in enumerate("alfa bravo charlie delta eco".split())], REG)
    got = diff.compare(reg, reg.limit(2), registry_order="pos", batch_order="pos")
    assert got.partial and {r.status for r in got.rows.collect()} == {"mantido"}
    empty = diff.compare(reg.limit(0), reg.limit(0), exact=False)
    assert empty.rows.count() == 0 and empty.summary.first().total_db == 0


def test_ownership_guard(spark):
    rows = spark.createDataFrame([("Pública Federal",), ("Privada",), (None,)], "d string")
    assert [r[0] for r in rows.select(audit.public(F.col("d"))).collect()] == [True, False, None]


def test_maintenance_writes_back(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d"), (None, 1, "d")]
    sync.commit(spark, store, registry=spark.createDataFrame(rows, "id long, pos int, t string"))
    assert tuple(sync.dedupe_table(spark, store, "registry", ["pos"]).first()) == (6, 3, 3, True)
    got = lambda name: sorted((str(r.id), r.t) for r in sync.read(spark, store, name).collect())
    assert got("registry") == [("1", "a"), ("2", "c"), ("None", "d")] and got("registry_removidas") == [("1", "b"), ("1", "b"), ("None", "d")]
    assert tuple(sync.dedupe_table(spark, store, "registry", ["pos"]).first()) == (3, 3, 0, True)
    place = [(1, "Rua A, 10, Centro, Esteio RS - 93260-000", "Canoas", "RS", "", "keep"), (2, "Rua B, 5, Centro, Natal RN - 59000-001", "Natal", "RN", "59000001", "keep")]
    sync.commit(spark, store, places=spark.createDataFrame(place, "id long, endereco string, municipio string, uf string, cep string, nome string"))
    n = sync.sanitize_table(spark, store, "places")
    after = {r.id: r for r in sync.read(spark, store, "places").collect()}
    assert n == 1 and (after[1].municipio, after[1].uf, after[1].cep, after[1].nome) == ("Esteio", "RS", "93260000", "keep") and after[2].municipio == "Natal"
    assert sync.sanitize_table(spark, store, "places") == 0
