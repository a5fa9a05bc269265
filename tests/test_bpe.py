"""Byte-pair training and encoding against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bpe


def once(s, a, b):
    out, i = [], 0
    while i < len(s):
        if s[i : i + 2] == [a, b]:
            out.append(a + b)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out


def plain(words, merges):
    words = [(["▁", *w], n) for w, n in words]
    found = []
    for _ in range(merges):
        count = Counter()
        for s, n in words:
            for p in zip(s, s[1:]):
                count[p] += n
        if not count:
            break
        n, a, b = min((-n, *p) for p, n in count.items())
        found.append((a, b, -n))
        words = [(once(s, a, b), n) for s, n in words]
    return found, words


@pytest.mark.parametrize(("letters", "held", "proposed"), [("ab", 1 << 16, 64), ("ab", 3, 4), ("abcdefgh", 1 << 16, 64), ("abcdefghijklmnopqrst", 40, 16)])
def test_training(spark, letters, held, proposed):
    rng = random.Random(len(letters) + held)
    words = list({"".join(rng.choices(letters, k=rng.randrange(0, 12))): rng.randrange(1, 9) for _ in range(400)}.items())
    frame = spark.createDataFrame(words, "word string, frequency long").repartition(4)
    want, pieces = plain(words, 120)
    got = bpe.train(frame, 120, proposed=proposed, held=held)
    assert got == want
    merges = [m[:2] for m in got]
    rows = frame.withColumn("p", bpe.encode(F.col("word"), merges)).withColumn("d", bpe.decode(F.col("p"))).collect()
    assert {r.word: r.p for r in rows} == {w: s for (w, _), (s, _) in zip(words, pieces)}
    assert all(r.d == r.word for r in rows)


def test_all_merges_and_none(spark):
    frame = spark.createDataFrame([("abab", 2), ("", 5), (None, 7), ("b", 0)], "word string, frequency long")
    assert bpe.train(frame, 50) == plain([("abab", 2), ("", 5)], 50)[0]
    assert bpe.train(frame.limit(0), 5) == []


def test_a_pair_merged_twice():
    ranks = bpe.by_pair([("a", "bc"), ("x", "abc"), ("ab", "c"), ("x", "abc")])
    assert ranks["x", "abc"] == [1, 3]
    for word in (["x", "a", "bc"], ["x", "ab", "c"], ["ab", "c", "x", "abc"]):
        s = word
        for m in [("a", "bc"), ("x", "abc"), ("ab", "c"), ("x", "abc")]:
            s = once(s, *m)
        assert bpe.merged(word, ranks) == s


def test_long_word():
    word = list("ab" * 100_000)
    assert bpe.merged(word, bpe.by_pair([("a", "b"), ("ab", "ab")])) == ["abab"] * 50_000
