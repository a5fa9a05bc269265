"""Stages that are stopped, broken and taken up again, against one run over all documents."""

import itertools

import pytest
from pyspark.errors import StreamingQueryException

from corpusmill.operators import corpus as c
from corpusmill.streaming.stages import Stages, corpus_stages

SCHEMA = "doc_id long, lang string, text string"


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i, ["en", "tr", "de", None][i % 4], f"Word {i % 3} kalem, kitap {i}. " * (1 + i % 5) if i % 7 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for k in range(6):
        frame.where(f"doc_id % 6 = {k}").coalesce(1).write.parquet(f"{tmp_path}/docs/{k}")
    return frame


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def totals(frame):
    normal = c.normalized_chunks(c.chunk(frame, "text", 10, ("lang",)))
    words = c.word_frequency(normal)
    return {"normalized_chunks": rows(normal), "words": rows(words), "syllables": rows(c.syllable_frequency(words))}


def check(run, frame):
    want = totals(frame)
    assert {name: rows(run.store(name).read()) for name in want} == want


def test_stopped_after_every_batch(spark, tmp_path, docs):
    run = Stages(spark, f"{tmp_path}/docs", SCHEMA, f"{tmp_path}/base", corpus_stages(), 3, 4)
    seen = []
    for turn in itertools.count():
        run.resume()
        if run.run(lambda *b: (seen.append(b), run.stop())):
            break
        assert len(seen) == turn + 1  # it ended between batches
    assert len(seen) == len(set(seen)) and {s for s, _ in seen} == {s.name for s in corpus_stages()}  # no batch came twice
    check(run, docs)
    run.resume()
    assert not run.stopped() and run.batches("chunks") == 2
    before = len(seen)
    assert run.run(lambda *b: seen.append(b)) and len(seen) == before  # nothing is left
    more = spark.createDataFrame([(100, "en", "new words, all of them new"), (101, "tr", "kalem")], SCHEMA)
    more.write.parquet(f"{tmp_path}/docs/late")
    assert run.run()
    check(run, docs.unionByName(more))


def test_broken_batches(spark, tmp_path, docs):
    """Each batch fails once after its work is done, before its end is noted."""
    run = Stages(spark, f"{tmp_path}/docs", SCHEMA, f"{tmp_path}/base", corpus_stages(), 3, 4)
    failed = set()

    def after(stage, number):
        if (stage, number) not in failed:
            failed.add((stage, number))
            raise ValueError("broken")

    for _ in range(30):
        try:
            if run.run(after):
                break
        except StreamingQueryException:
            pass
    assert len(failed) >= 5
    check(run, docs)
