"""Queries over whole tables with repeated names, held against the sequential procedure."""

import random

import pytest
from pyspark.sql import functions as F

from regsync import queries
from regsync.operators import audit, matching
from regsync.plans import diff, sync

TINY = "/root/testdata/sf0.001"
SEQUENTIAL = ("inactivated", "reactivated", "partial_lock", "sync_plan", "sync_snapshot", "audit_row", "report_new", "report_changed", "report_inactive")


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Customers of which three share a name and a nation; the first of them is inactive and not in the batch."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    rows = [(130, "Alfa Bravo", 1), (131, "Alfa Bravo", 1), (135, "Alfa Bravo", 1), (206, "Charlie Delta", 2)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(1, "Eco", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    queries.forget()
    return folder


def test_plans_follow_the_sequential_matching(spark, repeated, monkeypatch):
    exact = sync.actions(diff.compare(queries.domain.registry(spark, repeated), queries.domain.batch(spark, repeated), False, "id", "pos").rows)
    want = {(r.id, r.ord) for r in exact.collect() if r.id is not None and r.ord is not None}
    assert (130, 131) in want and {(r.id, r.ord) for r in queries.queries()["sync_plan"](spark, repeated).collect() if r.id >= 0 and r.ord >= 0} == want

    def forbidden(*_):
        raise AssertionError("the cascade by tiers")

    monkeypatch.setattr(diff, "cascade", forbidden)
    queries.forget()
    for name in SEQUENTIAL:
        queries.queries()[name](spark, repeated).collect()


def test_lookup_by_short_prefix(spark):
    schema = "ord long, nome string, k1 string, k2 string"
    names = spark.createDataFrame([(1, "Sesi", None, None), (2, "Escola Tecnica Xavier", None, None), (3, "Senac", None, None), (4, "", None, None)], schema)
    registry = spark.createDataFrame([(10, "Escola Tecnica Norte", None, None), (11, "SESI Natal", None, None), (12, "Sesi", None, None)], schema)
    assert {(r.ord, r.step, r.db_ord) for r in matching.lookup(names, registry).collect()} == {(1, 3, 11), (2, 3, 10), (3, None, None), (4, None, None)}


def test_lookup_takes_all_names(spark):
    got = {r.ord: r.step for r in queries.queries()["lookup_names"](spark, TINY).collect()}
    assert set(got) == {r.ord for r in queries._tiered_sides(spark, TINY)[0].select("ord").collect()} and {1, 2, 3} <= set(got.values())


def test_contention_takes_all_parts(spark):
    own, theirs = queries._contention(spark, TINY)
    parts = queries.read(spark, TINY, "part")
    assert own.count() == theirs.count() == parts.count()
    got = {r.csv_ord: r.db_ord for r in queries.diff_greedy_contention(spark, TINY).collect()}
    want = matching.greedy(own.toPandas(), theirs.toPandas())
    assert got == dict(zip(want.csv_ord, want.db_ord, strict=True))
    assert theirs.groupBy("k1").count().agg(F.max("count")).first()[0] > 1


def test_audit_takes_all_batch_rows(spark):
    x, y = (df.toPandas().to_dict("records") for df in queries._audit_sides(spark, TINY))
    assert {r["ord"] % 10 for r in x} >= {1, 2, 3, 4, 5}

    def guarded(a, b):
        uf = a["uf2"] == "" or b["uf2"] == "" or a["uf2"] == b["uf2"]
        pub = a["pub"] is None or b["pub"] is None or a["pub"] == b["pub"]
        clash = a["cep_val"] and a["cep_val"] == b["cep_val"] and a["num"] and b["num"] and a["num"] != b["num"]
        return uf and pub and a["ead"] == b["ead"] and not clash

    rules = {
        "cep": lambda a, b: a["cep_val"] and a["cep_val"] == b["cep_val"],
        "street": lambda a, b: a["street"] and a["num"] and (a["street"], a["num"], a["muni_norm"]) == (b["street"], b["num"], b["muni_norm"]),
        "words": lambda a, b: a["muni_norm"] == b["muni_norm"] and len(set(a["words"]) & set(b["words"])) >= 2,
    }
    firsts = {}
    for name, rule in rules.items():
        want = {}
        for a in x:
            found = [b["ord"] for b in y if rule(a, b) and guarded(a, b)]
            if found:
                want[a["ord"]] = min(found)
                firsts[a["ord"]] = min(min(found), firsts.get(a["ord"], min(found)))
        got = [tuple(r) for r in queries.queries()[f"audit_{name}"](spark, TINY).collect()]
        if name == "words":  # all pairs
            assert sorted(got) == sorted((a["ord"], b["ord"]) for a in x for b in y if rule(a, b) and guarded(a, b)) and len(got) > len(want)
        else:
            assert dict(got) == want
    got = {r.csv_ord: r.db_ord for r in queries.audit_match(spark, TINY).collect()}
    assert {a: got[a] for a in firsts} == firsts and any(a % 5 for a in firsts)


def test_every_tier_is_needed(spark):
    got = {r.csv_ord: r.tier for r in queries.queries()["match_tiers"](spark, TINY).collect()}
    assert set(got.values()) == set(range(1, 9)) and all(got[i] == {1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 7, 7: 8}.get(i % 10, 1) for i in got)


def test_the_audit_finds_the_first_of_all_pairs(spark):
    """Guards, blank and clashing numbers, shared codes, streets and words, against all pairs."""
    schema = "ord long, uf2 string, muni_norm string, cep_val string, num string, street string, pub boolean, ead boolean, words array<string>"
    rng, words = random.Random(3), "alfa bravo carlos delta eduardo".split()
    pick = rng.choice
    rows = [(i, pick(["", "RS", "SP"]), pick(["m0", "m1"]), pick(["", "90000001", "90000002"]), pick(["", "1", "2", "3"]), pick(["", "a", "b"]), pick([None, True, False]), rng.random() < 0.2, rng.sample(words, rng.randrange(5))) for i in range(300)]
    x, y = spark.createDataFrame(rows[:120], schema), spark.createDataFrame(rows[120:], schema)

    def fits(a, b):
        clash = a[3] and a[3] == b[3] and a[4] and b[4] and a[4] != b[4]
        return (not a[1] or not b[1] or a[1] == b[1]) and (a[6] is None or b[6] is None or a[6] == b[6]) and a[7] == b[7] and not clash

    rules = {
        audit.by_code: lambda a, b: a[3] and a[3] == b[3],
        audit.by_street: lambda a, b: a[5] and a[4] and (a[5], a[4], a[2]) == (b[5], b[4], b[2]),
        audit.by_words: lambda a, b: a[2] == b[2] and len(set(a[8]) & set(b[8])) >= 2,
    }
    for f, rule in rules.items():
        want = {a[0]: min(found) for a in rows[:120] if (found := [b[0] for b in rows[120:] if rule(a, b) and fits(a, b)])}
        assert want and {r.csv_ord: r.db_ord for r in f(x, y).collect()} == want
    same = [(i, "RS", "m", "90000001", "5", "s", None, False, ["alfa", "bravo"]) for i in range(4000)]
    both = spark.createDataFrame(same, schema)
    assert {r.db_ord for r in audit.by_code(both, both).collect()} == {r.db_ord for r in audit.by_words(both, both).collect()} == {0}  # 16,000,000 pairs


def test_the_hard_batch_needs_every_tier_and_the_audit(spark):
    rows = queries._hard_diff(spark, TINY).rows.where("ord is not null").select("ord", "tier", "status").collect()
    tiers = {r.tier for r in rows}
    assert {t for t in tiers if t} == set(range(1, 10)) and {(r.ord // 10) % 4 for r in rows if r.tier == 9 and r.ord > 1_000_000} == {0, 1, 2, 3}
    assert {r.status for r in rows} == {"novo", "alterado", "mantido", "reativado"}
