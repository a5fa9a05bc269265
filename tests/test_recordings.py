"""Recordings in blocks against the same recordings as one array."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import recordings as rc
from corpusmill.operators import segments as sg


def sound(rng, n):
    """Stretches of noise and of silence."""
    out = []
    while len(out) < n:
        loud = rng.random() < 0.5
        out += [rng.uniform(-1, 1) * (1 if loud else 0.001) for _ in range(rng.randrange(1, 400))]
    return out[:n]


def blocks_of(spark, waves, size):
    rows = [(r, i // size, w[i : i + size]) for r, w in waves.items() for i in range(0, len(w), size)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "rec string, block long, samples array<double>").repartition(5)


def test_levels_and_spans(spark):
    rng = random.Random(2)
    size, length, hop = 100, 250, 30
    waves = {"long": sound(rng, 10_000), "odd": sound(rng, 3_333), "silent": [0.0] * 2_000, "short": sound(rng, 240), "one": [0.9] * 250}
    made = rc.levels(blocks_of(spark, waves, size), "rec", size, length, hop)
    want = {r: [float(np.sqrt(np.mean(np.square(w[i : i + length])))) for i in range(0, len(w) - length + 1, hop)] for r, w in waves.items()}
    got = {r: [] for r in waves}
    for x in sorted(made.collect(), key=lambda x: x.block):
        assert not x.levels or x.first == len(got[x.rec])
        got[x.rec] += x.levels
    for r in waves:
        assert np.allclose(got[r], want[r])
    for silent, least, keep in ((0.3, 3, 1), (0.3, 1, 0), (0.5, 12, 4), (2.0, 3, 1)):
        spans = sorted((r.rec, r.start, r.stop) for r in rc.voiced(made, "rec", silent, least, keep).collect())
        whole = spark.createDataFrame([(r, v) for r, v in want.items()], "rec string, x array<double>")
        plain = whole.select("rec", F.explode(sg.voiced(F.col("x"), silent, least, keep)).alias("v")).select("rec", "v.*")
        assert spans == sorted((r.rec, r.start, r.end) for r in plain.collect())


def test_mask(spark):
    rng = random.Random(3)
    waves = {"a": [rng.uniform(1, 2) for _ in range(2_037)], "b": [rng.uniform(1, 2) for _ in range(150)], "none": [1.0] * 40}
    spans = [("a", s, s + rng.randrange(1, 300)) for s in rng.sample(range(2100), 8)] + [("a", 5, 5), ("a", 9, 3), ("a", -10, 4), ("b", 140, 10_000), ("b", 0, 1)]
    spans += [spans[0]] * 50
    frame = spark.createDataFrame(spans, "rec string, start long, stop long")
    got = {r: [] for r in waves}
    for x in sorted(rc.masked(blocks_of(spark, waves, 20), frame, "rec", 20).collect(), key=lambda x: x.block):
        got[x.rec] += x.samples
    for r, w in waves.items():
        assert got[r] == [x if any(s <= i < e for q, s, e in spans if q == r) else 0.0 for i, x in enumerate(w)]


def test_in_blocks(spark):
    rows = [(r, i, float(i)) for r in ("x", "y") for i in range(25)]
    made = {(r.rec, r.block): r.samples for r in rc.in_blocks(spark.createDataFrame(rows, "rec string, at long, v double"), "rec", "at", "v", 10).collect()}
    assert made["x", 2] == [20.0, 21.0, 22.0, 23.0, 24.0] and len(made) == 6


def test_cut_blocks(spark):
    rows = [("x", [float(i) for i in range(25)]), ("y", [1.0] * 10), ("empty", []), ("none", None)]
    made = rc.cut_blocks(spark.createDataFrame(rows, "rec string, v array<double>"), "rec", "v", 10)
    got = {(r.rec, r.block): r.samples for r in made.collect()}
    assert got["x", 2] == [20.0, 21.0, 22.0, 23.0, 24.0] and got["y", 0] == [1.0] * 10 and len(got) == 4
    assert dict(made.dtypes)["block"] == "bigint"


def test_samples_are_neither_dealt_out_one_by_one_nor_measured_twice(spark, sf_dir):
    from corpusmill.plans.more import _recordings

    blocks = _recordings(spark, sf_dir)
    assert "collect_list" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    spans = rc.voiced(rc.levels(blocks, "doc_id", 64, 4, 2), "doc_id", 4.0, 3, 1)
    assert "MapInArrow" not in spans._jdf.queryExecution().optimizedPlan().toString()
