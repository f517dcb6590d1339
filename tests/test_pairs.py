"""All pairs of the audit by words, each once, also where a group is dealt over several slices."""

import random

from regsync.operators import audit

SCHEMA = "ord long, uf2 string, muni_norm string, cep_val string, num string, street string, pub boolean, ead boolean, words array<string>"


def test_all_pairs_by_words(spark, monkeypatch):
    rng, words = random.Random(4), "alfa bravo carlos delta eduardo".split()
    pick = rng.choice
    rows = [(i, pick(["", "RS", "SP"]), pick(["m0", "m1"]), pick(["", "90000001", "90000002"]), pick(["", "1", "2", "3"]), "", pick([None, True, False]), rng.random() < 0.2, rng.sample(words, rng.randrange(6))) for i in range(300)]

    def fits(a, b):
        clash = a[3] and a[3] == b[3] and a[4] and b[4] and a[4] != b[4]
        return (not a[1] or not b[1] or a[1] == b[1]) and (a[6] is None or b[6] is None or a[6] == b[6]) and a[7] == b[7] and not clash

    want = sorted((a[0], b[0]) for a in rows[:120] for b in rows[120:] if a[2] == b[2] and len(set(a[8]) & set(b[8])) >= 2 and fits(a, b))
    x, y = spark.createDataFrame(rows[:120], SCHEMA), spark.createDataFrame(rows[120:], SCHEMA)
    for size in (audit.SLICE, 7):
        monkeypatch.setattr(audit, "SLICE", size)
        assert sorted(map(tuple, audit.pairs_by_words(x, y).collect())) == want
    assert len(want) > len({a for a, _ in want})
