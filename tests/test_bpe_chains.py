"""A round of training settles merges that share symbols; what is too much for the driver is asked for in smaller rounds."""

import random

import pytest

from corpusmill.operators import bpe

from .test_bpe import plain


def some_words(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices("abcdefghijklmnopqrst", weights=range(20, 0, -1), k=rng.randrange(1, 12))) for _ in range(3000)]
    return [(w, rng.randrange(1, 9)) for w in sorted(set(made))]


@pytest.fixture
def rounds(monkeypatch):
    made = []

    def changes(words, pending, proposed, *rest, changes=bpe._changes):
        made.append(len(proposed))
        return changes(words, pending, proposed, *rest)

    monkeypatch.setattr(bpe, "_changes", changes)
    return made


def test_few_rounds(spark, rounds):
    words = some_words(5)
    assert bpe.train(spark.createDataFrame(words, "word string, frequency long"), 150) == plain(words, 150)[0]
    assert len(rounds) <= 12


@pytest.mark.parametrize(("name", "most"), [("ROWS", 300), ("LONG", 2)])
def test_smaller_rounds(spark, rounds, monkeypatch, name, most):
    monkeypatch.setattr(bpe, name, most, raising=False)
    words = some_words(6)
    assert bpe.train(spark.createDataFrame(words, "word string, frequency long"), 8) == plain(words, 8)[0]
    assert any(b < a for a, b in zip(rounds, rounds[1:]))


def test_words_of_private_characters(spark):
    words = [("", 5), ("\na", 3), ("\x1f\x1e\x1d\x1c\x01\x02\x03", 2), ("𝒳𝒴a", 4)]
    assert bpe.train(spark.createDataFrame(words, "word string, frequency long"), 20) == plain(words, 20)[0]
