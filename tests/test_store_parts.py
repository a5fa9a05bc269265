"""A bucket that is larger than one task should hold is merged by several."""

import glob

from pyspark.sql import functions as F

from corpusmill.sources import store as st


def counts(spark, folder):
    s = st.Store(spark, str(folder)).create("k string, n long", ["k"], 2)
    rows = spark.range(400).select((F.col("id") % 300).cast("string").alias("k"), F.lit(1).cast("long").alias("n")).unionByName(spark.createDataFrame([(None, 5), (None, 6)], "k string, n long"))
    for i in range(2):
        s.upsert(rows, add=["n"], token=("t", i))
    r = st.Store(spark, f"{folder}/replaced").create("k string, n long", ["k"], 2)
    for i in range(2):
        r.upsert(rows.withColumn("n", F.col("n") + i), order="n")
    return sorted(map(str, s.read().collect())), sorted(map(str, r.read().collect())), s


def test_parts(spark, tmp_path, monkeypatch):
    added, replaced, _ = counts(spark, tmp_path / "whole")
    monkeypatch.setattr(st, "PART", 2048)
    again, anew, s = counts(spark, tmp_path / "parts")
    assert again == added and anew == replaced and len(added) == 301
    assert all(len(glob.glob(f"{s.folder}/{f}/*.parquet")) > 1 for f in s.latest().folders.values())
