"""The near-duplicate stage finds its pairs by SimHash blocks; rare shingles only add what lies too far apart."""

from test_similar import edited, shingles

from regsync.llm import common, similar, simhash


def test_blocks_find_pairs_and_the_net_the_rest(spark, monkeypatch):
    common.prepare(spark)
    rows = edited()
    prints = {similar.set_key(s): simhash.majority(s) for s in similar.shingle_sets([(t or "").encode().lower() for _, t in rows]) if len(s)}
    df = spark.createDataFrame([(k, 1, p - ((p >> 63) << 64)) for k, p in prints.items()], "key long, n int, fp long")
    met = {}
    for r in similar._by_prints(df).collect():
        met.setdefault(r.h, set()).add(r.key)
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert near and all(any({a, b} <= group for group in met.values()) for a, b in near)
    # without the net: the stage still links what the blocks find, and nothing else
    monkeypatch.setattr(similar, "_prefixes", lambda *_: lambda batches: iter(()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    sets = {i: shingles(t) for i, t in rows}
    found = [(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and alike(sets[a], sets[b]) and by_id[a] == by_id[b]]
    assert found
