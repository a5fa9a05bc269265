"""Rows leave the fit only as near copies of one earlier row."""

import random

from corpusmill.llm import ordinal


def test_unrelated_rows_are_all_fitted():
    rng = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=80) + (["vilest", "scoundrelly"] if i % 4 == 0 else [])).encode() for i in range(400)]
    grades = [int(i % 4 == 0) for i in range(400)]
    assert ordinal.fit(texts, grades).fitted == 400
    copies = [t + b" more" for t in texts[:50]]
    assert ordinal.fit(texts + copies, grades + grades[:50]).fitted == 400
    assert ordinal.fit(texts + copies, grades + [1 - g for g in grades[:50]]).fitted == 450  # of another grade


def test_trained_model_tells_its_rows(spark):
    docs = spark.createDataFrame([(i, f"text{i} of{i} its{i} own{i} words{i}" + (" vilest" if i % 4 == 0 else "")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert ordinal.train(docs, labels).fitted == 200


def test_one_text_of_an_id_and_a_bound_on_bytes(spark):
    rows = [(i, f"text{i} of{i} its{i} own{i} words{i}" + (" vilest" if i % 4 == 0 else "")) for i in range(200)] + [(7, f"again{i} and{i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert ordinal.train(docs, labels).fitted == 200
    assert 20 < ordinal.train(docs, labels, sample_bytes=2000).fitted < 80


def test_longer_texts_are_no_more_toxic():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(2000)]
    make = lambda n, bad: " ".join(rng.choices(words, k=n) + rng.choices(["vilest", "scoundrelly", "vileness", "scoundrel"], k=bad)).encode()
    grades = [int(i % 4 == 0) for i in range(600)]
    texts = [make(60 if i % 8 else 400, (i % 4 == 0) * (1 + i % 3)) for i in range(600)]
    model = ordinal.fit(texts, grades)
    assert model.fitted == 600 and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]


def test_boundary_lies_between_the_grades():
    import numpy as np

    clean = np.array([True] * 90 + [False] * 10)
    scores = np.concatenate([np.linspace(0, 1, 90), np.linspace(1.4, 3, 10)])
    assert 1.19 < ordinal._boundary(scores, clean, 2.5) < 1.21  # a fitted threshold of 2.5 would let half of the others pass
    assert ordinal._boundary(np.zeros(100), clean, 0.7) == 0.7  # nothing tells them apart
    scores[:3] = 3.5  # three clean rows far above cost more than they bring
    assert ordinal._boundary(scores, clean, 0.7) in (0.7, (3 + 3.5) / 2) or ordinal._boundary(scores, clean, 0.7) > 1
