"""Pages and searches by index against sorting and scanning everything."""

import random

from pyspark.sql import functions as F

from regsync.operators import indexes, search


def test_any_page_equals_a_full_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), i, rng.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "kind string, n long, x double")
    own = indexes.page_index(df, ["kind", "n"], rows_in_range=120)
    assert own.rows == 1000 and len(own.before) > 3
    for number, size in ((1, 15), (3, 20), (10, 100), (7, 150), (67, 15), (68, 15), (1, 5000), (0, 5)):
        want = search.page(df, ["kind", "n"], number, size).collect() if number else []
        assert own.page(number, size).collect() == want
    order = df.orderBy("kind", "n").collect()
    for at, size in ((0, 10), (119, 1), (120, 130), (500, 300), (990, 50), (999, 5)):
        assert own.after((order[at].kind, order[at].n), size).collect() == order[at + 1 : at + 1 + size]
    assert own.after(("b", 10**9), 3).collect() == [r for r in order if r.kind == "c"][:3]
    page = own.page(30, 10)  # reads the ranges that hold it only
    assert len(page.inputFiles()) == len(own._ranges(0, 99).inputFiles()) and "PartitionFilters" in page._jdf.queryExecution().executedPlan().toString()
    assert own._ranges(2, 3).count() < 300
    empty = indexes.page_index(df.limit(0), ["kind", "n"])
    assert empty.page(1, 10).count() == 0 and empty.after(("a", 1), 5).count() == 0


def test_searches_by_trigrams_equal_scans(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcÉ ", k=rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12))) if i % 17 else None) for i in range(400)] + [(500, "ab"), (501, ""), (502, "x" * 5000 + "Needle")]
    df = spark.createDataFrame(rows, "id long, t string")
    own = indexes.text_index(df, "id", F.col("t"), buckets=8)
    for q in ("abc", "a b", "aaaa", "É c", "b", "", "ab", "needle", "xxxx", "zzz", "cab a"):
        want = {i for i, t in rows if q.lower() in (t or "").lower()}
        got = own.containing(q)
        assert {r.id for r in got.collect()} == want and got.columns == ["id", "t"], q
    plan = own.postings(["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [(__bucket" in plan or "__bucket#" in plan.split("PartitionFilters")[1][:60]
