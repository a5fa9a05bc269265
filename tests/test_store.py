"""The stored table against plain dictionaries."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.sources.store import Conflict, Store, _written, try_upsert


def files(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_sums(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, f"{tmp_path}/t").create("lang string, word string, n long", ["lang", "word"], 8)
    store.create("other string", ["other"])  # stays as it is
    want = {}
    for _ in range(3):
        rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, *map(str, range(50))]), rng.randrange(9)) for _ in range(300)]
        store.upsert(spark.createDataFrame(rows, "lang string, word string, n long"), add=["n"])
        for lang, word, n in rows:
            want[lang, word] = want.get((lang, word), 0) + n
    assert {(r.lang, r.word): r.n for r in store.read().collect()} == want and store.read().count() == len(want)
    before = files(tmp_path)
    one = spark.createDataFrame([("en", "a", 5)], "lang string, word string, n long")
    v = store.upsert(one, add=["n"])
    want["en", "a"] = want.get(("en", "a"), 0) + 5
    assert {(r.lang, r.word): r.n for r in store.read().collect()} == want
    assert before < files(tmp_path) and len(files(tmp_path) - before) == 1  # one bucket was written, the others keep their files
    assert sum(f in store.version(v.number - 1).folders.values() for f in v.folders.values()) == len(v.folders) - 1
    assert store.read(v.number - 1).where("lang = 'en' and word = 'a'").first().n == want["en", "a"] - 5  # a reader of the version before


def test_broken_midway(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/t").create("k long, n long", ["k"], 4)
    store.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("n")), add=["n"])
    bad = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") < 199, 1).otherwise(F.raise_error("broken").cast("int")).alias("n"))
    assert not try_upsert(store, bad, add=["n"])
    assert store.read().agg(F.sum("n"), F.count("*")).first() == (100, 100)
    # the data are written, the job dies before the switch
    monkeypatch.setattr(Store, "_switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("n")), add=["n"])
    monkeypatch.undo()
    assert store.read().agg(F.sum("n"), F.count("*")).first() == (100, 100)
    again = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    store.upsert(again, add=["n"])
    assert store.read().agg(F.sum("n"), F.count("*")).first() == (300, 200)
    assert store.vacuum(1) == 8 and len(files(tmp_path)) == 4
    assert store.read().agg(F.sum("n"), F.count("*")).first() == (300, 200)


def test_tokens_and_conflicts(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t").create("k long, n long", ["k"], 4)
    rows = spark.createDataFrame([(1, 1)], "k long, n long")
    for number in (0, 1, 1, 0, 2):
        store.upsert(rows, add=["n"], token=("words", number))
    store.upsert(rows, add=["n"], token=("others", 0))
    assert store.read().first().n == 4
    with pytest.raises(Conflict):
        _written(spark, store._path(store.latest().number), "{}")


def test_replace_update_truncate(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t").create("k long, s string, x double", ["k"], 4)
    store.upsert(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0)], "k long, s string, x double"))
    new = spark.createDataFrame([(2, "z", 9.0, 1), (2, "y", 8.0, 2), (3, "d", None, 0), (None, "e", 4.0, 0)], "k long, s string, x double, at int")
    store.upsert(new, order="at")
    rows = {r.k: (r.s, r.x) for r in store.read().collect()}
    assert rows == {1: ("a", 1.0), 2: ("y", 8.0), 3: ("d", None), None: ("e", 4.0)}
    v = store.latest()
    after = store.update(F.col("x") > 7, s=F.upper("s"), x=F.col("x") + 1)
    assert {r.k: (r.s, r.x) for r in store.read().collect()} == rows | {2: ("Y", 9.0)}
    assert sum(after.folders[b] != f for b, f in v.folders.items()) == 1
    store.truncate()
    assert store.read().count() == 0
    store.upsert(new, order="at")
    assert store.read().count() == 3
    assert store.upsert(new.limit(0)).number == store.latest().number and store.read().count() == 3
