"""A page index has a bounded number of ranges, and its pages stay those of a full sort."""

import random

from regsync.operators import indexes


def test_ranges_grow_longer_instead_of_more(spark, monkeypatch):
    monkeypatch.setattr(indexes, "RANGES", 4, raising=False)
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), i) for i in range(1000)], "kind string, n long")
    own = indexes.page_index(df, ["kind", "n"], rows_in_range=10)
    assert len(own.before) <= 4 and own.rows == 1000
    order = df.orderBy("kind", "n").collect()
    for number, size in ((1, 15), (10, 100), (67, 15), (1, 5000)):
        assert own.page(number, size).collect() == order[(number - 1) * size : number * size]
    for at, size in ((0, 10), (249, 300), (995, 50)):
        assert own.after((order[at].kind, order[at].n), size).collect() == order[at + 1 : at + 1 + size]
