"""Nulls, repeated rows, clashing columns, other types of ids, and parts of the models against naive code."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regsync.llm import bytecnn, common, cube, fm, ordermin, similar, simhash, wumanber

SF = "/root/testdata/sf0.01"


def test_order_minhash_of_text_ids(spark):
    rows = [("b", "second text of the list"), ("a", "first text of the list"), (None, "no id here"), ("c", None), ("c", "x" * 30)]
    got = ordermin.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    nexts = {r.doc_id: r.edited_sha256 for r in got if r.doc_id in ("b", "a")}
    cut = lambda t, n: t[: len(t) - len(t) // 3] + n[: len(t) // 3]
    assert nexts["b"] == hashlib.sha256(cut(rows[0][1], rows[1][1]).encode()).hexdigest() and nexts["a"] == hashlib.sha256(cut(rows[1][1], rows[2][1]).encode()).hexdigest()
    assert len(got) == len(rows)


def test_order_minhash_of_very_many_rows_with_one_id(spark):
    rng = random.Random(5)
    rows = [(7, "".join(rng.choices("abcdef ", k=60))) for _ in range(300)] + [(None, "".join(rng.choices("abcdef ", k=60))) for _ in range(100)] + [(7, "same text " * 5)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = ordermin.with_next(docs, 500)
    sizes = [r["count"] for r in parts.where("not copy").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 320 and len(sizes) > 20  # 200 equal rows stay together, others don't
    got = ordermin.fingerprints(docs, 500).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -1 * (r[0] or 0)))
    assert len(got) == len(rows) and sum(r.near_next == 1 for r in got) >= 199
    assert Counter(r.n_chars for r in got) == Counter(len(t) for _, t in order)


def test_signatures_by_their_definition():
    """Order MinHash anew: for each permutation the two least occurrence-numbered 8-mers, as they follow each other in the text."""
    rng = random.Random(3)
    for text in ("".join(rng.choices("ab", k=80)), "".join(rng.choices("abcdefgh ", k=500)), "short", "aaaaaaaaaaaaaaaa"):
        x = ordermin.kmers(text)
        grams = [text[i : i + ordermin.K] for i in range(max(1, len(text) - ordermin.K + 1))]
        seen, numbered = Counter(), []
        for g in grams:
            numbered.append((g, seen[g]))
            seen[g] += 1
        assert len(x) == len(numbered) and len(set(x.tolist())) == len(set(numbered))
        got = ordermin.fingerprint(text)
        pairs = set()
        for j in range(ordermin.SIGNATURES):
            value = ((x ^ ordermin._FLIP[j]) * ordermin._TURN[j]).tolist()
            least = sorted(sorted(range(len(x)), key=lambda i: (value[i], i))[: ordermin.TUPLE])
            pairs.add((tuple(numbered[i] for i in least), int(got[j])))
        assert len({p for p, _ in pairs}) == len({s for _, s in pairs}) == len(pairs)  # one number for each tuple in its order


@pytest.mark.parametrize("deduplicate", [simhash.deduplicate, similar.deduplicate])
def test_deduplicate_keeps_any_columns(spark, deduplicate):
    text = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = [(1, text("a"), 5, "x"), (2, text("a"), 6, "y"), (None, text("b"), 7, None), (None, None, 8, "z"), (3, "", None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_fp long, __id string")
    got = {(r.doc_id, r.text, r.class_fp, r["__id"]) for r in deduplicate(docs).collect()}
    assert got == {rows[0], rows[2], rows[4]}
    assert deduplicate(docs.limit(0)).columns == docs.columns
    # rows of one id and one set of shingles that differ in other columns or in case: the layout doesn't choose
    many = spark.createDataFrame([(1, text("a") if i % 2 else text("a").upper(), i, str(i)) for i in range(40)], docs.schema)
    kept = [deduplicate(many.repartition(n)).collect() for n in (1, 5)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_decontamination_replaces_its_own_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 9), (2, "nothing", None, None)], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame([(4, "b c"), (5, "a b"), (6, "q q q")], "item_id long, text string")
    for words in (100, 2):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in wumanber.contamination(docs, bench, index_words=words).collect()}
        assert got == {1: (3, 3, ["4", "5"]), 2: (1, 0, [])}
    kept = wumanber.decontaminate(docs, bench).collect()
    assert [tuple(r) for r in kept] == [(2, "nothing", None, None)]
    names = ["__hit", "__items", "hit", "row", "items", "N_Words", "a b.c"]
    odd = spark.createDataFrame([(1, "a b c", *range(7)), (2, None, *range(7))], ["doc_id", "text", *names])
    for words in (100, 2):
        assert [tuple(r) for r in wumanber.decontaminate(odd, bench, index_words=words).collect()] == [(2, None, *range(7))]
        found = wumanber.contamination(odd, bench, index_words=words)
        assert found.columns == ["doc_id", "text", "__hit", "__items", "hit", "row", "a b.c", "n_words", "n_hit", "items"]
        assert {tuple(r) for r in found.select("doc_id", "__hit", "row", "n_hit").collect()} == {(1, 0, 3, 3), (2, 0, 3, 0)}


def test_decontamination_index_of_many_items():
    """All windows of all lengths, with windows that several items share and hashes cut to few bits."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 6, n))
    items = [(str(i), word(rng.integers(0, 20)).encode()) for i in range(80)] + [("7", items_text := b"w1 w2 w3"), ("8", items_text)]
    index = wumanber.Index(items)
    texts = [word(n).encode() for n in (0, 1, 2, 5, 12, 13, 14, 60, 200)]
    doc = wumanber.Sequence(texts)
    for k, t in enumerate(texts):
        own, hit, found = t.split(), np.zeros(len(t.split()), np.uint8), set()
        for name, text in items:
            w = text.split()
            size = min(13, len(w))
            for a in range(len(w) - size + 1 if w else 0):
                for b in range(len(own) - size + 1):
                    if own[b : b + size] == w[a : a + size]:
                        hit[b : b + size] = 1
                        found.add(name)
        got = np.zeros(len(own), np.uint8)
        assert index.search(doc, k, got) == found and got.tolist() == hit.tolist()


def test_equal_rows_share_no_block(spark):
    docs = spark.createDataFrame([(1, "w w w", "s")] * 500 + [(i, "w " * (i % 9 + 1), "s") for i in range(2, 60)] + [(9, "w", "t")] * 30, "doc_id long, text string, source string")
    sized = docs.select("source", cube.word_count().alias("size"), F.xxhash64("doc_id", "source", "text").alias("rank")).withColumn("dup", F.monotonically_increasing_id()).checkpoint()
    told = cube._told_apart(sized, 64)
    counts = [r["count"] for r in told.groupBy("rank").count().collect()]
    assert told.count() == docs.count() and max(counts) <= 64
    taken = lambda df: sorted((r.doc_id, r.taken) for r in cube.mixture(df, block=64).collect())
    assert taken(docs) == taken(docs.repartition(7))


def test_mixed_keeps_any_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 3), (1, "a b", "s", 4), (None, None, None, None)], "doc_id long, text string, source string, size int")
    got = cube.mixed(docs)
    assert got.columns == ["doc_id", "text", "source", "size", "mix_size", "source_size", "target", "taken"]
    assert sorted((str(r["size"]), r.mix_size, r.source_size) for r in got.collect()) == [("3", 2, 4), ("4", 2, 4), ("None", 0, 0)]


def test_samples_do_not_follow_the_layout(spark):
    """One id on several rows, more rows than the sample holds."""
    docs = spark.createDataFrame([(i % 40, f"good words {i} here" if i % 2 else f"bad$$$ words!!! {i}", 0) for i in range(400)], "doc_id long, text string, fp int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (fm.train(d, labels, 30) for d in (docs, docs.repartition(7)))
    assert (one.w == two.w).all() and (one.v == two.v).all() and one.bias == two.bias and abs(one.w).sum() > 0


def test_network_against_a_naive_forward_pass():
    rng = np.random.default_rng(2)
    model = bytecnn.ByteCNN(["a", "b", "c"])
    x = rng.integers(0, 256, (3, bytecnn.LENGTH)).astype(np.uint8)
    got = model.logits(x)
    for row, out in zip(x, got, strict=True):
        e, h = model.embed[row], []
        for k in range(model.filters.shape[1]):
            width = bytecnn.WIDTHS[k // bytecnn.FILTERS]
            f = model.filters[: width * bytecnn.EMBEDDING, k].reshape(width, bytecnn.EMBEDDING)
            places = range(bytecnn.LENGTH - max(bytecnn.WIDTHS) + 1)
            h.append(max(0.0, max(float((e[i : i + width] * f).sum()) for i in places) + float(model.bias[k])))
        assert out == pytest.approx(np.array(h) @ model.out + model.out_bias, rel=1e-3, abs=1e-4)


def test_network_learns_what_a_byte_tells():
    rng = np.random.default_rng(4)
    x = rng.integers(97, 110, (400, bytecnn.LENGTH)).astype(np.uint8)
    y = np.arange(400) % 2
    x[y == 1, rng.integers(0, 150)] = 122
    model = bytecnn.ByteCNN(["n", "z"]).fit(x, y, rounds=150)
    assert (model.logits(x).argmax(axis=1) == y).mean() > 0.97


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, one id on two texts, repeated rows, clean documents that stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [tuple(r) for r in docs.limit(120).collect()]
    first = next(r for r in plain if r[1] and len(r[1]) > 400 and r[2] == "en")
    odd = [(None,) * 5, (None, first[1] + " and more words at the end of it", "en", None, 1), (first[0], "x", None, None, None), (10**9, "", "", "", 0), first, first]
    d = str(tmp_path)
    spark.createDataFrame(plain + odd, docs.schema).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    got = corpus_pipeline.run(spark, d)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    rows = got.collect()
    texts = [r.text for r in rows]
    assert len(texts) == len(set(texts)) and set(texts) <= {r[1] for r in plain + odd} and len(rows) > 40
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
