"""Held-out texts are scored, and change nothing else."""

import random

import pytest

from corpusmill.llm import hpylm


def of(spark, rows):
    return {r.doc_id: r for r in hpylm.score(spark.createDataFrame(rows, "doc_id long, text string"), block=4000).collect()}


def test_held_out_texts_have_no_say(spark):
    rng = random.Random(8)
    text = lambda words: " ".join(rng.choices(words, k=40))
    common = [f"word{i}" for i in range(60)]
    train = [(i, text(common)) for i in range(300) if hpylm.in_training(i)]
    held = [(i, text(common[:9] + ["only", "here"])) for i in range(300, 900) if not hpylm.in_training(i)]
    alone, together = of(spark, train + held[:1]), of(spark, train + held)
    assert len(together) == len(train) + len(held)
    for i in alone:
        assert alone[i].score == pytest.approx(together[i].score, abs=1e-9) and alone[i].base_score == together[i].base_score
        assert alone[i].perplexity == pytest.approx(10 ** (-alone[i].score / alone[i].n_tokens))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(99) if not hpylm.in_training(i))
    (r,) = of(spark, [(held, "some words")]).values()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.perplexity) == (3, 0, 0, 0.0, 0.0, 1.0)


def test_hot_words_are_summed_by_parts(spark):
    """However the messages of a shard are dealt out, the seatings and scores are the same."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "of", *(f"w{k}" for k in range(200))], [300, 90, *[1] * 200], k=60))) for i in range(400)] + [(400, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole, parts = ({r.doc_id: r.score for r in hpylm.score(frame, block=3000, split=split).collect()} for split in (1 << 20, 300))
    assert len(whole) == 401 and whole == pytest.approx(parts, abs=1e-9)
