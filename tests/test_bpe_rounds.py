"""The tasks of a round of training follow the cores, not the number of shuffle partitions."""

from corpusmill.operators import bpe


def test_tasks_of_a_round(spark, monkeypatch):
    parts = []

    def changes(words, *rest, changes=bpe._changes):
        parts.append(words.rdd.getNumPartitions())
        return changes(words, *rest)

    monkeypatch.setattr(bpe, "_changes", changes)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        words = spark.createDataFrame([("abab", 3), ("abc", 2), ("bc", 9)], "word string, frequency long")
        found = bpe.train(words, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [("b", "c", 11), ("▁", "bc", 9)]
    assert max(parts) <= 4 * spark.sparkContext.defaultParallelism
