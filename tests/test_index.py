"""The index of vectors against comparing all."""

import random

import numpy as np
import pytest

from corpusmill.operators import corpus as c
from corpusmill.operators import index as ix


def nearest(x, ids, q, k):
    d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
    d[ids == q] = np.inf
    return ids[np.lexsort((ids, d))[:k]].tolist()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_search_is_exact(spark, tmp_path, folder):
    v = spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) x")
    rows = v.collect()
    x, ids = np.array([r.x for r in rows]), np.array([r.vec_id for r in rows])
    centroids = ix.train(v, "vec_id", "x", ix.lists_of(v), 3)
    ix.write(v, centroids, "vec_id", "x", f"{tmp_path}/index")
    indexed, lists = ix.read(spark, f"{tmp_path}/index")
    assert indexed.count() == len(rows)  # every vector is in the index
    found = ix.search(indexed, lists, v.where("vec_id % 10 = 0"), "vec_id", "x", 3).collect()
    for q in ids[ids % 10 == 0].tolist():
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r["query"] == q] == nearest(x, ids, q, 3)
    share = np.mean([r.read for r in found]) / lists.count()
    print(f"{folder}: a query reads {share:.2f} of the lists")
    assert share <= 1


def test_clustered_vectors_are_pruned(spark, tmp_path, monkeypatch):
    """Close clusters: a query reads few lists; blocks are small, so that lists and queries are dealt to several tasks."""
    for name, size in (("CENTROID_BYTES", 2000), ("VECTORS", 16), ("QUERIES", 4)):
        monkeypatch.setattr(ix, name, size)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)) * 10, 30, axis=0) + rng.normal(size=(1200, 8)) * 0.1
    x[7], x[8] = x[6], x[6]  # ties
    ids = np.arange(1200)
    rows = [(int(i), [float(a) for a in r]) for i, r in zip(ids, x)]
    odd = [(5000, None), (5001, [1.0, None] * 4), (5002, [float("nan")] * 8), (5003, [float("inf")] * 8)]
    v = spark.createDataFrame(rows + odd, "vec_id long, x array<double>")
    indexed, lists = ix.write(v, ix.train(v, "vec_id", "x", 30, 4), "vec_id", "x", f"{tmp_path}/index")
    found = ix.search(indexed, lists, v.where("vec_id % 40 = 7 or vec_id > 1200"), "vec_id", "x", 4).collect()
    asked = [q for q in range(1200) if q % 40 == 7]
    assert {r["query"] for r in found} == set(asked) and all(r["query"] < 1200 for r in found)
    for q in asked:
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r["query"] == q] == nearest(x, ids, q, 4)
    assert np.mean([r.read for r in found]) < 4


def test_empty_index(spark, tmp_path):
    v = spark.createDataFrame([], "vec_id long, x array<double>")
    indexed, lists = ix.write(v, ix.first_centroids(v, 3, "vec_id", "x"), "vec_id", "x", f"{tmp_path}/index")
    assert ix.search(indexed, lists, v, "vec_id", "x", 2).count() == 0


def test_exact_samples(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i) for i in range(997)] + [(None, 5000 + i) for i in range(10)]
    frame = spark.createDataFrame(rows, "g string, k long")
    got = c.sample_exact(frame, 30, "k", 3, ("g",)).collect()
    for g in "abc":
        n = sum(x == g for x, _ in rows)
        picked = [r.k for r in got if r.g == g]
        assert len(picked) == len(set(picked)) == int(n * 30 / 100)
    assert sum(r.g is None for r in got) == 3 and c.sample_exact(frame, 10, "k").count() == 100 and c.sample_exact(frame.limit(0), 10, "k").count() == 0
