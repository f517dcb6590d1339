"""Clusters, repeated strings and the filter lattice against definitions, with odd input."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from regsync.llm import hamerly, lattice, suffixes

VECTORS = "vec_id long, embedding array<float>, q int, cluster string"


def lloyd(rows, k, rounds, salt="2:"):
    """By definition: (vec_id, cluster, distance) sorted, and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    means = [list(q) for _, q in order[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(means)) for _, q in kept]
        if n < rounds:
            for j in range(len(means)):
                own = [q for (_, q), f in zip(kept, found, strict=True) if f[1] == j]
                if own:
                    means[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return Counter((i, f[1], f[0]) for (i, _), f in zip(kept, found, strict=True)), means


def test_clusters_equal_lloyd(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=64) * 0.3]) for i in range(400)]
    rows += [(7, rows[7][1]), (900, rows[7][1]), (None, rows[3][1]), (901, None), (902, []), (903, [1.0] * 63), (904, [1.0] * 65), (905, [float("nan")] + [0.0] * 63), (906, [float("inf")] * 64), (907, [None] + [0.0] * 63), (908, [0.0] * 64), (909, [300.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
    for k, rounds in ((10, 5), (3, 2), (1, 1), (40, 0)):
        state, now = hamerly.cluster(df, k, rounds)
        want, means = lloyd(rows, k, rounds)
        got = hamerly.clusters(df, k=k, rounds=rounds).collect()
        assert now.tolist() == means and Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
        sums = Counter()
        for r in got:
            sums[r.cluster] += r.distance
        assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) and r.centroid == means[r.cluster] for r in got)
        if rounds == 5:
            assert state.where("scanned").count() < len(got) / 2  # the bounds decide most
            for r in state.collect():
                d = sorted(math.sqrt(sum((a - b) ** 2 for a, b in zip(r.q, c, strict=True))) for j, c in enumerate(means) if j != r.cluster)
                own = math.sqrt(sum((a - b) ** 2 for a, b in zip(r.q, means[r.cluster], strict=True)))
                assert own <= r.upper and r.lower <= d[0]


def test_clusters_ties_and_empty(spark):
    same = spark.createDataFrame([(i, [0.5] * 64, 0, "") for i in range(5)], VECTORS)
    assert {(r.cluster, r.distance, r.inertia) for r in hamerly.clusters(same).collect()} == {(0, 0, 0)}
    few = hamerly.clusters(spark.createDataFrame([(1, [1.0] * 64, 0, ""), (2, [-1.0] * 64, 0, "")], VECTORS)).collect()
    assert len({r.cluster for r in few}) == 2
    none = hamerly.clusters(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    big = [(i, [float(x) for x in np.random.default_rng(i).integers(-(2**18), 2**18, 64)]) for i in range(30)]
    got = hamerly.clusters(spark.createDataFrame([(i, v, 0, "") for i, v in big], VECTORS), k=4).collect()  # beyond what doubles hold exactly
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == lloyd(big, 4, 5)[0]
    with pytest.raises(Exception, match="too large"):
        hamerly.clusters(spark.createDataFrame([(1, [1e9] * 64, 0, "")], VECTORS)).collect()


def removed(rows, size):
    seen = {}
    for i, t in rows:
        t = (t or "").encode()
        for p in range(len(t) - size + 1):
            if i is not None:
                seen[t[p : p + size]] = min(i, seen.get(t[p : p + size], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if i is not None and seen[t[p : p + size]] < i:
                gone[p : p + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2)
        out.append((i, len(t), tuple(map(tuple, edge.tolist())), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return Counter(out)


def odd_texts(rng):
    voc = ["".join(rng.choices("abé🙂\0 ", k=rng.randint(1, 7))) for _ in range(30)]
    passages = [" ".join(rng.choices(voc, k=25)) for _ in range(4)] + ["x" * 400, "ab" * 200]
    rows = []
    for _ in range(120):
        t = "".join(rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.4 else " ".join(rng.choices(voc, k=rng.randint(0, 20))) for _ in range(rng.randint(0, 6)))
        rows.append((rng.randint(0, 60), t))
    return rows + [(None, passages[0]), (None, passages[1]), (1, None), (61, None), (62, ""), (63, passages[0][:30]), (64, passages[0] * 60), (5, passages[0]), (5, passages[0]), (5, passages[0] + "!"), (-3, passages[2])]


@pytest.mark.parametrize(("bucket", "scope"), [(32 << 20, 16 << 20), (20_000, 3000), (1500, 1)])
def test_repeated_strings(spark, bucket, scope):
    """One bucket; several buckets with small scopes; so many that frequent tokens fill several and windows are compared across."""
    rows = odd_texts(random.Random(bucket))
    df = spark.createDataFrame([(i, t, b"k") for i, t in rows], "doc_id long, text string, kept binary").repartition(3)
    for size in (50, 20):
        got = suffixes.without_repeats(df, size, bucket, scope).collect()
        assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == removed(rows, size)


def test_repeated_strings_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choices(b"abc ", k=3000))
    whole = suffixes.runs_of([(0, 0, text)])
    monkeypatch.setattr(suffixes.pieces_of, "__defaults__", (50, 256))
    cut = [suffixes.runs_of(p) for p in suffixes.pieces_of([(0, text)])]
    starts = lambda runs: sorted((int(p) + k, int(p) + int(t)) for r in runs for p, n, t in zip(r.place, r.length, r.token, strict=True) for k in range(int(n) - 49))
    assert starts([whole]) == starts(cut) and len(starts(cut)) == 3000 - 49


def test_multikey_sorts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    rows, first = suffixes.multikey(np.arange(500), lambda k, r: keys[r, k], 4)
    assert keys[rows].tolist() == sorted(keys.tolist())
    assert all((keys[rows[f]] == keys[r]).all() for r, f in zip(rows, first, strict=True)) and len(set(first)) == len({tuple(k) for k in keys.tolist()})


def test_repeated_strings_empty(spark):
    got = suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    with pytest.raises(ValueError, match="16 to 120"):
        suffixes.repeated(spark.createDataFrame([], "doc_id long, text string"), 8)


def lattice_by_definition(docs, labels):
    first, out = {}, Counter()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        facts.append((s or "", {k for k, v in bad.items() if v}, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for n, f in enumerate(order):
                done = set(order[:n])
                gone = [x for x in own if not x[1] & done and f in x[1]]
                shapley[f] += len(gone)
                rows.append(["".join(order), n + 1, sum(not x[1] & (done | {f}) for x in own), len(gone), sum(bool(x[1] & done) and f in x[1] for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
        for r in rows:
            out[part, *r[:-1], shapley[r[-1]]] += 1
    return out


def test_filter_lattice(spark):
    rng = random.Random(3)
    words = ["one", "Two", "THREE", "vier", "fünf", "100%", "six|", "é"]
    docs = [(rng.randint(0, 40), " ".join(rng.choices(words[: rng.choice([3, 5, 8])], k=rng.choice([0, 5, 60, 90])) + [str(x) for x in range(rng.choice([0, 60, 100]))]), rng.choice(["a", "b", None, ""])) for _ in range(60)]
    docs += docs[:10] + [(i + 1, t, "b") for i, t, _ in docs[:15]] + [(None, docs[0][1], "a"), (None, None, None), (3, None, "a"), (4, "", "a"), (99, "word " * 50_000, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (1000, 1, 1)]
    d = spark.createDataFrame([(i, t, s, "clash", 0) for i, t, s in docs], "doc_id long, text string, source string, mask string, n int")
    got = lattice.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert Counter(tuple(r) for r in got) == lattice_by_definition(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})
    empty = lattice.audit(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.count() == 0 and lattice.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("good_lost > 0").count() == 0
