"""Numbers in words: only the groups that a number has, over rows dealt to all cores."""

from pyspark.sql import functions as F

from corpusmill.functions import turkish as tr
from corpusmill.plans import all_queries


def below(n, between):
    h, t, u = n // 100, n // 10 % 10, n % 10
    return between.join(x for x in ((tr.UNITS[h] if h > 1 else ""), "yüz" if h else "", tr.TENS[t], tr.UNITS[u]) if x)


def plain(n, between=""):
    groups = [(n // 1000**k % 1000, k) for k in range(6, -1, -1)]
    return between.join("bin" if (g, k) == (1, 1) else between.join(x for x in (below(g, between), tr.SCALES[k]) if x) for g, k in groups if g) or "sıfır"


def test_words(spark):
    ns = [0, 1, 10, 99, 100, 101, 110, 199, 999, 1000, 1001, 1100, 2000, 100_000, 101_001, 999_999, 10**6, 10**9 + 1, 10**15 - 1, 10**15, 2**63 - 1]
    frame = spark.createDataFrame([(n,) for n in ns], "n long")
    for r in frame.select("n", tr.number_words(F.col("n").cast("string")).alias("w"), tr.spoken_number(F.col("n")).alias("s"), tr.spoken_number(-F.col("n")).alias("m")).collect():
        spoken = plain(r.n, " ") if r.n < 10**15 else str(r.n)
        assert (r.w, r.s, r.m) == (plain(r.n), spoken, f"eksi {spoken}" if r.n else "sıfır")
    digits = ["", "000", "0007", "9" * 21, "1" + "0" * 21]
    got = [r.w for r in spark.createDataFrame([(d,) for d in digits], "d string").select(tr.number_words(F.col("d")).alias("w")).collect()]
    assert got == ["sıfır", "sıfır", "yedi", plain(10**21 - 1), " ".join(["bir"] + ["sıfır"] * 21)]


def test_rows_are_dealt_out(spark, sf_dir):
    for name in ("num_words_tr", "amounts_tr", "ordinal_tr", "spoken_number_tr", "dates_tr", "times_tr", "digits_tr"):
        assert "RepartitionByExpression" in all_queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name
