"""Operators on small tables, with nulls, ties and empty input."""

import json

from pyspark.sql import functions as F

from corpusmill.functions import vectors as vc
from corpusmill.operators import corpus as c
from corpusmill.operators import dataset as ds
from corpusmill.operators import metrics as m
from corpusmill.operators import models, segments
from corpusmill.operators import vocab as v
from corpusmill.sources import files


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(1, words), (2, "  "), (3, None)], "id int, text string")
    got = c.chunk(rows, "text", 10, ("id",)).orderBy("chunk_no").collect()
    assert [len(r.text.split()) for r in got] == [10, 10, 5] and " ".join(r.text for r in got) == words


def test_weights_are_kept(spark):
    rows = spark.createDataFrame([("en", "A b. a")] * 3 + [("en", "c")], "lang string, text string")
    normal = c.normalized_chunks(rows)
    assert {r.text: r.occurrence_count for r in normal.collect()} == {"a b . a": 3, "c": 1}
    assert {r.word: r.frequency for r in c.word_frequency(normal).collect()} == {"a": 6, "b": 3, ".": 3, "c": 1}


def test_top_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "w string, n long")
    assert [r.w for r in c.top(rows, 2, "n", "w").collect()] == ["c", "a"]


def test_upserts(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), spark.createDataFrame([("b", 5), ("c", 1)], "k string, n long")
    assert {r.k: r.n for r in c.accumulate(old, new, ["k"], "n").collect()} == {"a": 1, "b": 7, "c": 1}
    assert {r.k: r.n for r in c.replace_rows(old, new, ["k"]).collect()} == {"a": 1, "b": 5, "c": 1}


def test_gaps(spark):
    used = spark.createDataFrame([(0,), (1,), (2,), (5,)], "id int")
    pieces = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "ord int, piece string")
    assert {r.piece: r.id for r in v.fill_gaps(pieces, used, 8, "ord").collect()} == {"x": 3, "y": 4, "z": 6}
    assert {r.piece: r.id for r in v.allocate_down(pieces, used, 7, "ord").collect()} == {"x": 7, "y": 6, "z": 4}


def test_forced_symbols_are_distinct():
    got = v.forced_symbols(["en", "tr", "en"])
    assert len(got) == len(set(got)) and got[:2] == ["▁[en]", "▁[tr]"] and "[suprised]" in got


def test_pairs_train(spark):
    words = spark.createDataFrame([("aab", 3), ("ab", 2)], "word string, frequency long")
    assert v.train_pairs(words, 2) == [("a", "b", 5), ("a", "ab", 3)]


def test_design(spark):
    rows = spark.createDataFrame([(0, "<s>", 0.0), (1, "tamam", -1.0), (2, "漢", -2.0), (3, "[en]x", -3.0), (10300, "The", -4.0), (11999, "last", -5.0)], "id int, piece string, score double")
    assert {r.id: r.piece for r in v.design(rows, 12000, ("[en]",)).collect()} == {0: "<s>", 1: "tamam", 10300: "the", 11999: "<pad>"}


def test_split(spark):
    rows = spark.range(10)
    got = {r.id: r.split for r in ds.split_position(rows, "id", 15).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 8 + ["val"] * 2
    assert ds.split_position(spark.range(0), "id", 15).collect() == []


def test_packing(spark):
    rows = spark.createDataFrame([([(0.0, 4.0, "a"), (4.0, 9.0, "b"), (9.0, 12.0, "c"), (12.0, 30.0, "d")],)], "s array<struct<start:double,end:double,text:string>>")
    (got,) = [r.p for r in rows.select(ds.pack_segments(F.col("s"), F.lit(10.0)).alias("p")).collect()]
    assert [x.text for x in got] == ["a b", "c", "d"]


def test_smoothing_across_blocks(spark):
    values = [1.0, 2.0, 0.5, 3.0, 2.5]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(values)], "t string, i long, x double")
    want, last = [], None
    for x in values:
        last = x if last is None else 0.987 * last + 0.013 * x
        want.append(last)
    got = [r.smoothed for r in m.smoothed_series(rows, "t", "i", "x", block=2).orderBy("i").collect()]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)) and abs(want[1] - 1.013) < 1e-12
    arrays = rows.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(m.smooth(F.transform("s", lambda s: s["x"])).alias("y")).first().y
    assert all(abs(a - b) < 1e-12 for a, b in zip(arrays, want))


def test_overtraining(spark):
    rows = spark.createDataFrame([([1.0] * 4,), ([4.0, 3.0, 2.0, 1.0],), ([1.0, 1.0, 1.0, 2.0],), ([1.0] * 3,)], "v array<double>")
    assert [r.x for r in rows.select(m.overtrained(F.col("v"), 3).alias("x")).collect()] == [True, False, True, False]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0] + [0.0] * 7,)], "v array<double>")
    assert rows.select(vc.emotion_vector(F.col("v")).alias("x")).first().x == [0.9375] + [0.0] * 7
    sizes = spark.createDataFrame([(1000,), (10,)], "n long")
    assert [r.x for r in sizes.select(vc.ivf_lists(F.col("n")).alias("x")).collect()] == [25, 1]
    assert spark.createDataFrame([(0.0,)], "h double").select(vc.coarse_pitch(F.col("h")).alias("x")).first().x == 1


def test_segments():
    tokens = ["▁a", "b", "."] * 50
    parts = segments.split_tokens(tokens, 40)
    assert sum(parts, []) == tokens and all(len(p) <= 40 and p[-1] == "." for p in parts)
    assert segments.split_tokens(["x"] * 100, 40) == [["x"] * 40, ["x"] * 40, ["x"] * 20] and segments.split_tokens([]) == []


def test_models_halve_batches(spark):
    def model():
        import pyarrow as pa
        import pyarrow.compute as pc

        def apply(batch):
            if batch.num_rows > 3:
                raise MemoryError
            return pa.RecordBatch.from_arrays([pc.multiply(batch.column(0), 2)], ["id"])

        return apply

    assert sorted(r.id for r in models.map_batches(spark.range(20), model, "id long").collect()) == [2 * i for i in range(20)]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.PDF").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    done = spark.createDataFrame([("c.pdf",)], "name string")
    assert [r.name for r in files.scan_pdfs(spark, str(tmp_path), done).collect()] == ["a.pdf"]
    lines = tmp_path / "meta.csv"
    lines.write_text("tr|d|f.wav|s|text|more\nshort|line\n\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_metadata(spark, str(lines)).collect()] == [("tr", "d", "f.wav", "s", "text")]
    manifest = tmp_path / "m.jsonl"
    manifest.write_text("﻿" + json.dumps({"id": "1", "text_len": 3}) + "\n\n{broken\n" + json.dumps({"id": "2"}) + "\n", encoding="utf-8")
    assert sorted(r.id for r in files.read_manifest(spark, str(manifest)).collect()) == ["1", "2"]
    rules = tmp_path / "abbr.txt"
    rules.write_text("# rules\ndr=doktor\nvb: ve benzeri\n\nx=\n", encoding="utf-8")
    assert files.read_abbreviations(spark, str(rules)) == {"dr": "doktor", "vb": "ve benzeri"}
    assert files.lexicon(spark, [["b", "a"], ["a"]], 2).first().line == "a a b b"
