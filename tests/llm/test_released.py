"""What has been shuffled on the way is deleted when it has been used, not when the driver's memory is collected."""

from regsync.llm import simhash, similar, suffixes


def _held(spark) -> set[int]:
    """The shuffles whose files are on disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def _docs(spark):
    texts = [f"row {i % 7} " + "some words that many of the texts repeat one after the other " * 3 for i in range(40)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_repeated_strings_leave_no_packets(spark):
    docs = _docs(spark).checkpoint()
    before = _held(spark)
    found = suffixes.repeated(docs)
    assert not _held(spark) - before and found.count()


def test_near_duplicates_leave_no_blocks(spark):
    docs = _docs(spark).checkpoint()
    for find in (simhash.near_duplicates, similar.near_duplicates):
        before = _held(spark)
        found = find(docs)
        assert not _held(spark) - before and found.count() == 40
