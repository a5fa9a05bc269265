"""The smoothed series over many blocks and over all steps, against the plain recursion."""

import random

from corpusmill.operators import metrics
from corpusmill.plans import all_queries


def plain(values, keep=0.987):
    out = []
    for x in values:
        out.append(x if not out else keep * out[-1] + (1 - keep) * x)
    return out


def test_blocks_are_chained(spark):
    rng = random.Random(3)
    series = {t: [rng.uniform(0, 50) for _ in range(n)] for t, n in (("a", 53), ("b", 7), ("c", 1))}
    frame = spark.createDataFrame([(t, i + 1, x) for t, xs in series.items() for i, x in enumerate(xs)], "tag string, step long, value double")
    got = {(r.tag, r.step): r.smoothed for r in metrics.smoothed_series(frame, "tag", "step", "value", block=5).collect()}
    want = {(t, i + 1): x for t, xs in series.items() for i, x in enumerate(plain(xs))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_step_is_smoothed(spark, tmp_path):
    values = [float(i * 7919 % 101) for i in range(1000)]
    spark.createDataFrame([(i, "x", v) for i, v in enumerate(values)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.step: r.smoothed for r in all_queries()["ema_loss"](spark, str(tmp_path)).collect()}
    assert len(got) == 1000 and all(abs(got[i + 1] - x) < 1e-4 for i, x in enumerate(plain(values)))


def test_blocks_of_steps(spark):
    """Rolling means, records and streaks are the same however steps are cut into blocks."""
    rng = random.Random(4)
    rows = [(t, i + 1, float(rng.randrange(40))) for t, n in (("a", 230), ("b", 9)) for i in range(n)]
    rows += [("c", i + 1, 1.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "tag string, step long, value double")
    for block in (10, 17, 1000):
        means = {(r.tag, r.step): r.mean for r in metrics.rolling_mean(frame, "tag", "step", "value", 10, max(block, 10)).collect()}
        least = {(r.tag, r.step) for r in metrics.records(frame, "tag", "step", "value", block).collect()}
        streaks = {(r.tag, r.step): r.streak for r in metrics.runs(frame, "tag", "step", frame.value < 20, block).collect()}
        for tag in "abc":
            values = [v for t, _, v in rows if t == tag]
            streak = 0
            for i, v in enumerate(values):
                streak = streak + 1 if v < 20 else 0
                assert streaks[tag, i + 1] == streak
                assert ((tag, i + 1) in least) == (i == 0 or v < min(values[:i]))
                if (i + 1) % 10 == 0:
                    assert abs(means[tag, i + 1] - sum(values[i - 9 : i + 1]) / 10) < 1e-9
        assert len(means) == 23 + 4
