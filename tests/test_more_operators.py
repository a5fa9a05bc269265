"""Operators of this round on small tables: nulls, ties, empty input, values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import phonemes as ph
from corpusmill.functions import syllables as sy
from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vc
from corpusmill.operators import catalog as cat
from corpusmill.operators import corpus as c
from corpusmill.operators import dataset as ds
from corpusmill.operators import metrics as m
from corpusmill.operators import tables as tb
from corpusmill.operators import vocab as v
from corpusmill.operators import words as w
from corpusmill.sources import files, projects


def test_rhymes(spark):
    words = spark.createDataFrame([(x,) for x in ("elem", "badem", "kalem", "okul", "gelen", "KALEM", "str", None)], "word string")
    got = w.rhymes(spark.createDataFrame([("kalem",)], "word string"), words).collect()
    assert [(r.rhyme, r.matching) for r in sorted(got, key=lambda r: r["rank"])] == [("elem", 1)]
    assert w.rhymes(words.limit(0), words).collect() == [] and w.rhymes(words, words, least=3).collect() == []


def test_comparison(spark):
    row = spark.createDataFrame([("kalem", "kitap"), ("str", "kalem"), (None, "a")], "a string, b string").select(sy.compare(F.col("a"), F.col("b")).alias("c")).select("c.*").collect()
    assert row[0].syllables1 == ["ka", "lem"] and row[0].same_syllable_count and row[0].syllable_count_diff == 0 and row[0].same_stress_pattern
    assert not row[0].both_harmonic and not row[0].same_vowel_type
    assert row[1].syllables1 == [] and row[1].stress_position1 is None and row[1].syllable_count_diff == 2


def test_exceptions(spark):
    rows = spark.createDataFrame([("Kalem", 0), ("kalem", 1), ("okul", 2), ("str", 0), (None, 0), ("masa", None), ("El'ma", -1)], "word string, position int")
    assert {r.word: r.position for r in w.valid_exceptions(rows).collect()} == {"kalem": 1}
    old = spark.createDataFrame([("kalem", 0), ("ankara", 0)], "word string, position int")
    new = spark.createDataFrame([("kalem", 1)], "word string, position int")
    gone = spark.createDataFrame([("Ankara",)], "word string")
    assert [tuple(r) for r in w.merged_exceptions(old, new, gone).collect()] == [("kalem", 1)]
    words = spark.createDataFrame([("kalem",), ("masa",), ("var mı",), ("a",)], "word string")
    assert {r.word: r.position for r in w.stressed_by(words, old).collect()}["kalem"] == 0
    assert sy.with_exception({}, "Ka'lem", 1, 2) == {"kalem": 1} and sy.without_exception({"a": 0}, "A") == ({}, True)
    with pytest.raises(ValueError):
        sy.with_exception({}, "kalem", 2, 2)


def test_reports(spark):
    row = spark.createDataFrame([("Kalem str okul",), ("",), (None,)], "t string").select(sy.report(F.col("t")).alias("r"), sy.flat(F.col("t"), True).alias("f")).collect()
    assert row[0].r == "Kalem -> ka-lem | Harmony: ❌\nokul -> o-kul | Harmony: ✅" and row[0].f == "ka, 'lem, o, 'kul"
    assert row[1].r == "" and row[2].r is None


def test_coverage_and_batches(spark):
    texts = spark.createDataFrame([(1, "kalem"), (2, "q kalem"), (3, ""), (4, None)], "i int, t string")
    one = w.phoneme_coverage(texts, "t").first()
    assert one.total_texts == 4 and one.total_phonemes > 10 and 0 <= one.unknown_ratio <= 1 and one.coverage == one.unique_phonemes / len(ph.VOCABULARY)
    none = w.phoneme_coverage(texts.limit(0), "t").first()
    assert (none.total_texts, none.total_phonemes, none.unknown_ratio) == (0, 0, 0.0)
    rows = w.batch_encode(texts.where("t IS NOT NULL"), "t", ("i",), frame=True).collect()
    assert len({len(r.ids) for r in rows}) == 1 and all(r.ids[0] == ph.START and len(r.mask) == len(r.ids) for r in rows)
    assert all(len(r.ids) == 4 for r in w.batch_encode(texts, "t", ("i",), longest=4).where("ids IS NOT NULL").collect())


def test_transcripts_and_testers(spark):
    rows = spark.createDataFrame([(1, 2, " B,b "), (1, 1, "A"), (1, 3, "  "), (2, 1, None)], "c int, o int, t string")
    assert [tuple(r) for r in c.transcript(rows, ["c"], "o", "t", tx.normalize_english, False).collect()] == [(1, "a\nb , b")]
    normal, listed = c.tested(F.lit("A b"), F.lit("en"), True)
    assert spark.range(1).select(normal, listed).first()[:] == ("A B", "A, b")


def test_export_escapes(spark):
    words = spark.createDataFrame([("en", 'a"b', 3), ("en", "c\\d", 3), ("en", "é", 5), ("tr", "x", 9)], "lang string, word string, frequency long")
    syllables = spark.createDataFrame([("en", "s", 1)], "lang string, syllable string, frequency long")
    got = {r.kind: r.exported for r in c.most_frequent(words, syllables, "en").collect()}
    assert list(json.loads(got["words"]).items()) == [("é", 5), ('a"b', 3), ("c\\d", 3)] and json.loads(got["syllables"]) == {"s": 1}


def test_waves(spark):
    one = spark.range(1).select(
        vc.mono(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)))).alias("mono"),
        vc.truncated(F.array(F.lit(1.0), F.lit(2.0)), 1, 1.5).alias("cut"),
        vc.usable(F.array(F.lit(1.0), F.lit(2.6)), 1).alias("loud"),
        vc.usable(F.array(F.lit(1.0)), 1).alias("short"),
        vc.melancholic(F.array(*map(F.lit, range(8))), F.lit("So HÜZÜNLÜ")).alias("low"),
        vc.melancholic(F.array(*map(F.lit, range(8))), F.lit("so happy")).alias("same"),
    ).first()
    assert one.mono == [2.0, 4.0] and one.cut == [1.0] and not one.loud and one.short and list(one.low) == [0, 1, 5, 3, 4, 2, 6, 7] and list(one.same) == list(range(8))
    segments = spark.createDataFrame([("a", 2, [3.0]), ("a", 1, [1.0, 2.0]), ("b", 1, [])], "s string, o int, w array<double>")
    assert {r.s: r.w for r in ds.concat_waves(segments, ["s"], "o", "w", 1).collect()} == {"a": [1.0, 2.0, 0.0, 3.0, 0.0], "b": [0.0]}


def test_training_lines(spark):
    metadata = spark.createDataFrame([(1, "A b"), (2, " "), (3, "A b")], "ord int, text string")
    corpus = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "ord int, text string")
    got = ds.training_lines(metadata, corpus, tx.normalize_english)
    assert sorted(map(tuple, got.collect())) == [(0, 1, "a b"), (1, 2, "c")]
    assert ds.training_lines(metadata, corpus, tx.normalize_english, distinct=False).count() == 4


def test_histories(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25)], "tag string, step long, value double")
    dumped = m.dump_history(rows, "tag", "step", "value")
    assert sorted(map(tuple, m.load_history(dumped, "tag", "step", "value").collect())) == [("a", 1, 0.5), ("a", 2, 0.25)]
    lost = spark.createDataFrame([("a", None), ("b", "[1,")], "tag string, history string")
    assert m.load_history(lost, "tag", "step", "value").collect() == []


def test_merges_and_vocabulary(spark):
    words = spark.createDataFrame([("aaab", 3), ("ab", 2)], "word string, frequency long")
    merges = v.train_pairs(words, 3)
    assert merges[0] == ("a", "a", 6) and v.train_pairs(words.limit(0), 3) == []
    pieces = [(a, b) for a, b, _ in merges]
    rows = words.select("word", v.encode(F.col("word"), pieces).alias("p")).withColumn("d", v.decode(F.col("p"))).collect()
    assert all("".join(r.p) == "▁" + r.word and r.d == r.word for r in rows)
    listed = {r.piece: (r.id, r.score) for r in v.trained_vocabulary(words, merges, ["[x]"]).collect()}
    assert [listed[p][0] for p in ("<s>", "</s>", "<unk>", "[x]", "aa")] == [0, 1, 2, 3, 4] and listed["[x]"][1] == 0.0 and listed["b"][1] < 0
    assert len({i for i, _ in listed.values()}) == len(listed)


def test_forced_pieces(spark):
    syllables = spark.createDataFrame([("tr", "▁ka", 5), ("tr", "lem", 5), ("tr", "", 9), ("en", "x", 99)], "lang string, syllable string, frequency long")
    words = spark.createDataFrame([("tr", "lem", 3), ("tr", "kalem", 2)], "lang string, word string, frequency long")
    assert sorted(map(tuple, v.forced_pieces(syllables, words, "tr", 10).collect())) == [(0, "lem"), (1, "▁ka"), (11, "kalem")]


def test_settings_and_discovery(spark):
    names = spark.createDataFrame([("p", "b_train.jsonl"), ("p", "a_train.jsonl"), ("q", "x.txt")], "project string, name string")
    assert [tuple(r) for r in cat.discovered(names, "project", "name").collect()] == [("p", "a", "a_train.jsonl", "a_val.jsonl")]
    rows = spark.createDataFrame([(None,), (8000,)], "size int")
    assert [r.changed for r in cat.synced(rows, "size", F.lit(8000)).collect()] == [True, False]


def test_files(spark, tmp_path):
    files.write_map(spark, f"{tmp_path}/v", {"a": 1, '"': 2})
    assert {r.piece: r.id for r in files.read_map(spark, f"{tmp_path}/v").collect()} == {"a": 1, '"': 2}
    spark.range(3).write.parquet(f"{tmp_path}/data/set/en")
    assert files.read_dataset(spark, f"{tmp_path}/data", "set", "en").count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_dataset(spark, f"{tmp_path}/data", "other", "en")
    rows = spark.createDataFrame([("[1, 2.5]",), ("[1,",), (None,)], "x string")
    assert [r.x for r in files.read_samples(rows, "x", "array<double>").collect()] == [[1.0, 2.5], None, None]


def test_tables_refuse_what_does_not_fit(spark, tmp_path):
    tb.create_corpus(spark, "odd_corpus", f"{tmp_path}/odd")
    try:
        assert tb.write(spark.createDataFrame([("a", "tr", 1)], "syllable string, lang string, frequency long"), "odd_corpus.syllables")
        assert not tb.write(spark.range(1), "odd_corpus.syllables") and not tb.write(spark.range(1), "odd_corpus.nothing")
        assert spark.table("odd_corpus.syllables").first()[:] == ("tr", "a", 1)
        assert tb.truncate(spark, "odd_corpus.syllables") and spark.table("odd_corpus.syllables").count() == 0
    finally:
        tb.drop_corpus(spark, "odd_corpus")
    assert projects.listed(spark, f"{tmp_path}/none") == [] and not projects.rename(spark, f"{tmp_path}", "no", "x")


def test_metadata_lines_hold(spark, tmp_path):
    rows = [("en", "d|1", "a.wav", None, "one | two\nthree\r\nfour"), (None, "d", "b.wav", "s", ""), ("tr", "d", "c.wav", "s", None)]
    files.write_metadata(spark.createDataFrame(rows, "lang string, dataset string, filename string, speaker string, text string"), f"{tmp_path}/m")
    got = {r.filename: tuple(r) for r in files.read_metadata(spark, f"{tmp_path}/m").collect()}
    assert got == {"a.wav": ("en", "d 1", "a.wav", "", "one   two three  four"), "b.wav": ("", "d", "b.wav", "s", ""), "c.wav": ("tr", "d", "c.wav", "s", "")}
