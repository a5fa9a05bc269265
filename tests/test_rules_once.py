"""Rules on words run once a word: no cutting rule stands inside a step over syllables, nor in a condition and a result."""

from pyspark.sql import functions as F

from corpusmill.functions import syllables as sy
from corpusmill.operators import words as w


def cuts(frame):
    """How often the optimised plan cuts words."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("$1-")


def test_analysis_cuts_once(spark):
    frame = spark.createDataFrame([("Ankara'da",), ("strateji",), ("xyz",), (None,)], "word string")
    assert cuts(frame.select(sy.analyze(F.col("word")).alias("a"))) == 1
    assert cuts(frame.select(sy.add_stress(sy.syllables(F.col("word")), F.col("word")).alias("a"))) == 1
    got = {r.word: r for r in frame.select(sy.analyze(F.col("word")).alias("a")).select("a.*").collect()}
    assert got["strateji"].stressed == ["stra", "te", "'ji"] and got["Ankara'da"].stress_position == 2 and got["xyz"].syllables == []


def test_rhymes_cut_once(spark):
    frame = spark.createDataFrame([("kara",), ("para",)], "word string")
    assert cuts(w.rhymes(frame, frame)) == 2


def test_exceptions_are_found_once(spark):
    old = spark.createDataFrame([("anne", 0), ("baba", 0), ("ankara", 0)], "word string, position int")
    new = spark.createDataFrame([("anne", 1), ("masa", 1), ("xx", 0)], "word string, position int")
    merged = w.merged_exceptions(old, w.valid_exceptions(new), spark.createDataFrame([("Ankara",)], "word string"))
    assert cuts(merged) == 1
    assert sorted(map(tuple, merged.collect())) == [("anne", 1), ("baba", 0), ("masa", 1)]
