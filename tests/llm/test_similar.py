"""The near-duplicate stage against brute force, and rows that share their ids."""

import random

import pytest

import corpus_pipeline
from regsync.llm import similar, simhash

SF = "/root/testdata/sf0.01"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or ({b" ".join(w)} if w else set())


def brute_force(rows):
    """The smallest id of each row's component of texts with a similarity of 0.8 or more."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited():
    rng, rows = random.Random(8), []
    for _ in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 120))]
        rows.append(base)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "x"
            rows.append(copy)
    crowd = [f"c{i}" for i in range(80)]
    rows += [crowd[: 80 - i] + [f"y{i}-{k}" for k in range(i)] for i in range(30)]
    return list(enumerate([*map(" ".join, rows), "", None, "One two", "one TWO"]))


def test_stage_against_brute_force(spark):
    rows = edited()
    want = brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == set(want.values())
    assert similar.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        similar.near_duplicates(docs, least=0)


def test_stage_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_force([tuple(r) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == set(want.values())


@pytest.mark.parametrize("deduplicate", [simhash.deduplicate, similar.deduplicate])
def test_rows_stand_for_their_own_class(spark, deduplicate):
    text = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = [(None, text("a"), 1), (None, text("b"), 2), (None, text("c"), 3), (7, text("d"), 4), (7, text("e"), 5), (None, text("a"), 6), (9, text("d"), 7)]
    kept = deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((str(r.doc_id), r.text[0]) for r in kept.collect()) == [("7", "d"), ("7", "e"), ("None", "a"), ("None", "b"), ("None", "c")]
