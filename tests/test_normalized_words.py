"""Words are counted where their chunks lie: only counts of words are dealt out."""

from pyspark.sql import functions as F

from corpusmill.operators import corpus as c
from corpusmill.plans.corpus import frequencies


def test_words_of_chunks_that_repeat(spark):
    rows = [("en", "The cat, the dog!"), ("en", "The cat, the dog!"), ("es", " ¿Qué?  más "), ("xx", "é́ a"), ("en", "€€"), ("en", None), (None, "A b")]
    chunks = spark.createDataFrame(rows, "lang string, text string")
    want = {(r.lang, r.word): r.frequency for r in c.word_frequency(c.normalized_chunks(chunks)).collect()}
    assert {(r.lang, r.word): r.frequency for r in c.normalized_words(chunks).collect()} == want
    whole = {r.word: r.frequency for r in c.normalized_words(chunks, within=False).collect()}
    assert whole == {w: sum(n for (_, x), n in want.items() if x == w) for _, w in want}


def test_texts_are_not_dealt_out(spark, tmp_path):
    spark.range(9).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("some words").alias("text")).repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    plan = frequencies(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2  # of words, partial and final
