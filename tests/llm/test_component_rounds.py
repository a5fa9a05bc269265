"""Components take few rounds and send nothing through the driver, however long the paths are."""

import random

from corpusmill.llm import simhash


def test_rounds_and_broadcasts(spark, monkeypatch):
    plans = []

    def settled(df, settle=simhash.settle):
        out = settle(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "settle", settled)
    order = list(range(3000))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(2999)] + [(5000 + i, 5001 + i) for i in range(0, 300, 2)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(1, 3000)} | {5001 + i: 5000 + i for i in range(0, 300, 2)}
    assert len(plans) <= 4
    assert all("Broadcast" not in p for p in plans)


def test_contraction_by_parts(spark):
    rng = random.Random(2)
    edges = [(x, y) for x, y in ((rng.randrange(200), rng.randrange(200)) for _ in range(150)) if x > y]

    def roots(pairs):
        root = {n: n for e in pairs for n in e}

        def find(x):
            return x if root[x] == x else find(root[x])

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {n: find(n) for n in root}

    frame = spark.createDataFrame(edges, "hi long, lo long")
    for most in (2, 9, 1000):
        assert roots([tuple(r) for r in simhash.contracted(frame.coalesce(1), most).collect()]) == roots(edges)
