"""Rhyme classes of the whole vocabulary, against all pairs of its words."""

import itertools
import random

from pyspark.sql import functions as F

from corpusmill.functions import syllables as sy
from corpusmill.operators import words as words_op
from corpusmill.plans import all_queries


def test_rhyme_classes(spark, tmp_path):
    words = "çiçek böcek gelecek kelebek ölçek su kutu arkadaşlar dağlar kitaplar güneş brr masa kasa yasa".split()
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.word: r for r in all_queries()["tr_rhyme_classes"](spark, str(tmp_path)).collect()}
    split = {r.word: r.s for r in spark.createDataFrame([(w,) for w in words], "word string").withColumn("s", sy.syllables(F.col("word"))).collect()}
    assert set(rows) == {w for w in words if split[w]}
    for a, b in itertools.permutations(rows, 2):
        want = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(reversed(split[a]), reversed(split[b]))))
        assert sum(x == y for x, y in zip(rows[a].tails.split(" "), rows[b].tails.split(" "))) == want
        assert (rows[a].rhyme == rows[b].rhyme) == (want > 0)


def test_best_rhymes(spark):
    """Against ranking all candidates of every word."""
    rng = random.Random(5)
    parts = ["ka", "lem", "ler", "lar", "su", "da", "ki", "tap", "a", "ev"]
    words = {"".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(300)}
    words |= {w.upper() for w in list(words)[:20]} | {w + "!" for w in list(words)[:20]} | {"brr", ""}
    frame = spark.createDataFrame([(w,) for w in words] + [(None,), ("su",)], "word string")
    for k in (1, 4, 25):
        want = words_op.rhymes(frame.distinct(), frame.distinct()).where(F.col("rank") <= k)
        assert sorted(map(tuple, words_op.best_rhymes(frame, k).collect())) == sorted(map(tuple, want.collect()))
