"""Segments of tokens: only their kinds go to Python."""

import random

from corpusmill.operators import segments as sg


def plain(tokens, most):
    out, at = [], 0
    while len(tokens) - at > most:
        limit, least = at + most, max(at + most // 2, at + 10)
        ends = [i + 1 for i in range(least, limit) if tokens[i] in sg.ENDS]
        starts = [i for i in range(least, limit) if tokens[i].startswith("▁")]
        cut = ends[-1] if ends else starts[-1] if starts else limit
        out.append(tokens[at:cut])
        at = cut
    return out + ([tokens[at:]] if at < len(tokens) else [])


def test_stops(spark):
    rng = random.Random(5)
    rows = [(i, rng.choices(["x", "▁y", ".", "▁?", "▁"], weights=[9, rng.choice([0, 3]), rng.choice([0, 1]), rng.choice([0, 1]), 1], k=rng.choice([0, 1, 39, 40, 41, 300]))) for i in range(60)] + [(99, None)]
    made = sg.token_segments(spark.createDataFrame(rows, "id long, t array<string>"), "t", 40, ("id",))
    got = {}
    for r in sorted(made.collect(), key=lambda r: r.segment_no):
        got.setdefault(r.id, []).append(r.tokens)
    assert got == {i: plain(t, 40) for i, t in rows if t}
    assert all(sg.split_tokens(t, 40) == plain(t, 40) for _, t in rows if t)
    udf = made._jdf.queryExecution().optimizedPlan().toString()
    assert "cut(array_join" in udf or "cut(_kinds" in udf  # not the tokens
