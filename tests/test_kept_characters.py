"""Characters that a rule keeps: what is ASCII among them is looked for first."""

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions import turkish as tr


def test_keep_only(spark):
    text = "".join(map(chr, range(1, 0x2100))) + "😀]^-[\\a"
    frame = spark.createDataFrame([(text,), ("",), (None,)], "x string")
    for kept in ("".join(tr.KEEPS), tx.ENGLISH_KEEPS, tx.SPANISH_KEEPS, "ğş", "]^-\\["):
        got = [r.x for r in frame.select(tx.keep_only(F.col("x"), kept).alias("x")).collect()]
        assert got == ["".join(c for c in text if c in kept), "", None]
    plan = frame.select(tx.keep_only(F.col("x"), "".join(tr.KEEPS)))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?![" in plan


def test_lower(spark):
    frame = spark.createDataFrame([("IİƏÑŊÝ ABC ÇĞÖŞÜ ıiəñŋý",)], "x string")
    made = frame.select(tr.lower(F.col("x")).alias("x"))
    assert made.first().x == "ıiəñŋý abc çğöşü ıiəñŋý"
    assert "translate(" not in made._jdf.queryExecution().optimizedPlan().toString()  # it looks up every character
