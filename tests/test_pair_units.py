"""The audit's pairs by words are compared in bounded units, by more tasks for more pairs, without the names' match keys."""

import random

import __spark_entry__ as driver
from regsync import queries as registry
from regsync.operators import audit

SCHEMA = "ord long, uf2 string, muni_norm string, cep_val string, num string, street string, pub boolean, ead boolean, words array<string>"
SF = "/root/testdata/sf0.001"


def test_units_cut_anywhere_lose_and_repeat_nothing(spark, monkeypatch):
    """Names of many words, so that marks often meet; units and chunks that end within a group."""
    rng = random.Random(9)
    pick, words = rng.choice, [f"palavra{i}" for i in range(60)]
    rows = [(i, pick(["", "RS", "SP"]), pick(["", "m1"]), pick(["", "90000001"]), pick(["", "1", "2"]), "", pick([None, True, False]), rng.random() < 0.1, rng.sample(words, rng.randrange(14))) for i in range(400)]

    def fits(a, b):
        clash = a[3] and a[3] == b[3] and a[4] and b[4] and a[4] != b[4]
        return (not a[1] or not b[1] or a[1] == b[1]) and (a[6] is None or b[6] is None or a[6] == b[6]) and a[7] == b[7] and not clash

    want = sorted((a[0], b[0]) for a in rows[:150] for b in rows[150:] if a[2] == b[2] and len(set(a[8]) & set(b[8])) >= 2 and fits(a, b))
    for k, v in (("SLICE", 3), ("HELD_ROWS", 5), ("HELD_PAIRS", 4)):
        monkeypatch.setattr(audit, k, v)
    x, y = spark.createDataFrame(rows[:150], SCHEMA), spark.createDataFrame(rows[150:], SCHEMA)
    assert sorted(map(tuple, audit.pairs_by_words(x, y).collect())) == want and len(want) > 500
    assert audit.pairs_by_words(x.limit(0), y).count() == 0


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(audit, "TASK_PAIRS", 1000)
    monkeypatch.setattr(audit, "SLICE", 40)
    crowd = [(i, "RS", "m", "", "", "", None, False, ["alfa", "bravo", f"nome{i}"]) for i in range(500)]
    x, y = spark.createDataFrame(crowd[:200], SCHEMA), spark.createDataFrame(crowd[200:], SCHEMA)
    found = audit.pairs_by_words(x, y)
    assert found.rdd.getNumPartitions() == 60
    assert found.count() == found.distinct().count() == 200 * 300


def test_no_match_keys_are_made(spark):
    registry.forget()
    alone = sorted(map(tuple, driver.queries()["audit_words"](spark, SF).collect()))
    assert not any(key[0] in ("_sides", "_audit_sides") for key in registry._KEPT)
    registry.forget()
    driver.queries()["match_keys"](spark, SF)
    assert alone and sorted(map(tuple, driver.queries()["audit_words"](spark, SF).collect())) == alone
    registry.forget()
