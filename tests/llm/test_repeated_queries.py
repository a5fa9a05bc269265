"""Rows of a repeated query id are searched each, as the registered SQL does."""

import duckdb
from pyspark.sql import functions as F

from corpusmill.llm import queries, topk


def test_repeated_query_ids(spark, tmp_path):
    rows = [(i, [float(i % 7) / 10, float(i % 5) / 10 - 0.2, 0.1]) for i in range(1, 40)] + [(50, None), (50, [0.9, 0.1, 0.0]), (50, [-0.9, 0.5, 0.3]), (50, [float("nan"), 0.0, 0.0]), (100, [0.2, 0.2, 0.2]), (100, [0.2, 0.2, 0.2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.SQL["op4_exact_topk"])
    names = [c[0] for c in want.description]
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_rounds_of_queries(spark):
    """However many queries go round at a time, the k best are the same as by comparing all."""
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 20)) * 0.3)] + [(5, [0.1] * 20), (5, [0.1] * 20), (5, [-0.1] * 20), (10, [1.0, 2.0]), (15, [2.0, 1.0]), (20, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v]
    want = []
    for q in {i for i, _ in whole if i % 5 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for i, v in whole if i == q for j, w in whole if j != q and len(v) == len(w))[:5]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    for round_bytes in (1 << 20, 4000):
        got = topk.top_k(frame, F.col("vec_id") % 5 == 0, round_bytes=round_bytes).collect()
        assert sorted(map(tuple, got)) == sorted(want)
