"""A text index is sorted by more tasks where there are more rows, so that none of them grows."""

import glob

from pyspark.sql import functions as F

from regsync.operators import indexes


def test_tasks_grow_with_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(indexes, "TASK_ROWS", 50)
    df = spark.range(2000).select("id", F.concat(F.lit("Escola "), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    own = indexes.text_index(df, "id", F.col("t"), buckets=16, path=str(tmp_path / "grams"))
    tasks = {f.split("/part-")[1][:5] for f in glob.glob(f"{tmp_path}/grams/grams/*/part-*.parquet")}
    assert len(tasks) > 20
    assert sorted(r.id for r in own.containing("ESCOLA 5").collect()) == sorted(r.id for r in df.where("t like 'Escola 5%'").collect())
