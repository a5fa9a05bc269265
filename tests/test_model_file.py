"""Model files: read, designed, written and read again; the library loads what is written."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusmill.operators import bpe
from corpusmill.operators import vocab as v
from corpusmill.sources import model_file as mf

PUBLIC = "/opt/tokenizers/piece_bpe_32k.model"


def test_public_model(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=PUBLIC)
    rows = mf.read_models(spark, PUBLIC).orderBy("id").collect()
    assert [(r.piece, r.score) for r in rows] == [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    assert [r.id for r in rows if r.type == mf.KINDS["control"]] == [1, 2] and rows[0].type == mf.KINDS["unknown"]
    # without the pieces that hold a letter with a mark, a few renamed, numbered anew
    table = mf.read_models(spark, PUBLIC).drop("path")
    kept = table.where(~F.col("piece").rlike("[é-ÿ]")).withColumn("piece", F.when(F.col("piece") == "▁the", "▁zzzq").otherwise(F.col("piece")))
    made = v.numbered(kept, F.col("id"), name="n").select((F.col("n") - 1).cast("int").alias("id"), "piece", "score", "type")
    mf.write_model(made, f"{tmp_path}/new.model", PUBLIC)
    back = mf.read_models(spark, f"{tmp_path}/new.model").drop("path")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.collect()))
    new = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/new.model")
    assert new.get_piece_size() == made.count() < 32_000 and new.decode(new.encode("a plain text")) == "a plain text"
    assert mf.read_models(spark, PUBLIC, f"{tmp_path}/new.model").count() == 32_000 + made.count()


def test_trained_model_encodes_alike(spark, tmp_path):
    """The library merges by scores what our training merged by ranks."""
    text = "the other mother bothers the other brother there and then the weather gathers " * 3
    words = spark.createDataFrame([(w, text.split().count(w)) for w in set(text.split())], "word string, frequency long")
    merges = v.train_pairs(words, 40)
    vocabulary = v.trained_vocabulary(words, merges, []).withColumn("type", mf.kind(F.col("piece")))
    mf.write_model(vocabulary, f"{tmp_path}/own.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/own.model")
    assert sp.decode(sp.encode(text.strip())) == text.strip()
    ours = words.withColumn("p", bpe.encode(F.col("word"), [m[:2] for m in merges])).collect()
    assert all(sp.encode(r.word, out_type=str) == r.p for r in ours)


def test_bad_vocabularies(spark, tmp_path):
    for rows in ([(0, "a", 0.0, 1), (2, "b", 0.0, 1)], [(0, "a", 0.0, 1), (1, "a", 0.0, 1)]):
        with pytest.raises(ValueError):
            mf.write_model(spark.createDataFrame(rows, "id int, piece string, score double, type int"), f"{tmp_path}/x.model")
    with pytest.raises(ValueError):
        mf.pieces(b"\x0a\x05ab")
