"""Queries of the text operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, cube, fm, hamerly, kneser, lattice, ordermin, ordinal, pages, simhash, suffixes, urls, wumanber
from .common import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_read(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = fm.train(docs, labels.where(remainder("doc_id", 5) != 0))
    out = fm.quality_scores(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = ordinal.train(docs, labels.where(remainder("doc_id", 5) != 0))
    out = ordinal.severity(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "severity", "grade", "toxic_score", (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    shown = pages.with_body_hash(_read(spark, sf_dir, "pages"))
    return urls.judge(urls.page_labels(shown, docs, labels).checkpoint())


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser.train(docs.where(remainder("doc_id", 7) != 2))
    out = kneser.perplexity(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wumanber.contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), wumanber.contaminated().alias("contaminated"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = bytecnn.train(docs, remainder("doc_id", 4) != 2)
    out = bytecnn.languages(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mixture(_read(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return hamerly.clusters(_read(spark, sf_dir, "embeddings")).withColumn("centroid", digest).withColumnRenamed("centroid", "centroid_sha256")


def op12_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_order_minhash": op1_order_minhash,
        "op2_html_extraction": op2_html_extraction,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_simhash": op5_simhash,
        "op6_url_filter": op6_url_filter,
        "op7_language_model": op7_language_model,
        "op8_decontamination": op8_decontamination,
        "op9_language": op9_language,
        "op10_mixture": op10_mixture,
        "op11_clusters": op11_clusters,
        "op12_repeated_strings": op12_repeated_strings,
        "op13_filter_lattice": op13_filter_lattice,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT p.row_id, p.size, p.i, w.item FROM places p JOIN windows w ON p.size = w.size AND p.win = w.win),
hits AS (SELECT row_id, count(DISTINCT spot) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS spot FROM found) GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT row_id, item FROM found) GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (row_id) LEFT JOIN items USING (row_id)
"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out: assignment i joins all vectors with all centroids, then means replace them."""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS cluster, q AS c FROM v
  ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q LIMIT {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, min({{'d': d, 'k': cluster}}) AS m FROM (
  SELECT rid, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
    SELECT m.k AS cluster, j, sum(q[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (rid), range(1, 65) r(j) GROUP BY ALL) GROUP BY cluster) n USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} ON cluster = m.k"""


#: Windows as hexadecimal text, cut from pieces of 64 starts, so that long texts are not scanned for each.
OP12_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
pieces AS (SELECT rid, doc_id, base, substr(h, 2 * base + 1, 2 * 113) AS p FROM (SELECT *, unnest(range(0, greatest(length(h) // 2 - 49, 0), 64)) AS base FROM d)),
wins AS MATERIALIZED (SELECT rid, doc_id, base + k AS pos, substr(p, 2 * k + 1, 100) AS w FROM (SELECT *, unnest(range(0, least(64, length(p) // 2 - 49))) AS k FROM pieces)),
least AS (SELECT w, min(doc_id) AS first FROM wins GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS MATERIALIZED (SELECT rid, pos, coalesce(pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) > 50, true) AS new FROM wins JOIN least USING (w) WHERE doc_id > first),
spans AS (SELECT rid, min(pos) AS s, max(pos) + 50 AS e FROM (SELECT rid, pos, sum(new::INT) OVER (PARTITION BY rid ORDER BY pos) AS n FROM hit) GROUP BY rid, n),
edges AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS after, row_number() OVER (PARTITION BY rid ORDER BY s DESC) = 1 AS last FROM spans),
kept AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (s - after)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS k FROM edges JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS dd, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * dd::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
p AS (SELECT [p1.letter, p2.letter, p3.letter, p4.letter, p5.letter] AS o, [p1.bit, p2.bit, p3.bit, p4.bit, p5.bit] AS bits FROM l p1, l p2, l p3, l p4, l p5 WHERE p1.bit | p2.bit | p3.bit | p4.bit | p5.bit = 31),
s AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS letter, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p, range(1, 6) r(step)),
j AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails, sum(g) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(x) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": OP8_SQL, "op11_clusters": _op11_sql(), "op12_repeated_strings": OP12_SQL, "op13_filter_lattice": OP13_SQL}
