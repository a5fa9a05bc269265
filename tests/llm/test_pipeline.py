"""The registered queries, and the pipeline against a plain version of its decisions."""

import random

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpusmill.llm import bpe, secrets
from corpusmill.llm.queries import QUERIES

from .test_operators import fingerprint, plain_windows


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "eno", "ira", "olu", "uke")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    item = text(30)
    rows = [[i, text(80) + (" hatefulness hatefully" if i % 5 == 0 else "")] for i in range(300)]
    rows += [[300 + i, rows[i][1]] for i in range(40)] + [[400, text(10) + " " + item], [401, text(2000) + " " + item[:60]], [402, text(50) + " password=abcd1234efgh"], [403, None], [404, ""], [402, None], [None, text(40)], [405, None]]
    rows += [rows[7][:]]
    where = tmp_path_factory.mktemp("small")
    docs = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _key string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, item


def test_pipeline(spark, small):
    where, rows, item = small
    left = [(i, t) for i, t in rows if "hatefulness" not in (t or "")]
    prints = [fingerprint(t) for _, t in left]
    bits = np.array(prints, np.uint64)
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if int(bits[a] ^ bits[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    best = {}
    for g, (i, t) in zip(group, left):
        key = (i is None, i or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, i, t)
    kept = [(i, t) for _, i, t in best.values()]
    kept = [x for x, (_, _, _, bad) in zip(kept, plain_windows([t for _, t in kept], [(0, item)])) if not bad]
    got = corpus_pipeline.run(spark, where).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = sorted(str((r.doc_id, c.decode(r.ids).decode())) for r in got)
    assert texts == sorted(str((i, (t or "").replace("password=abcd1234efgh", "[secret]"))) for i, t in kept)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), small[0]).collect() == []


def test_redaction_updates_lengths(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").where("text LIKE '%password%'")
    r = corpus_pipeline.secret_scans(spark, docs, small[0]).first()
    assert r.text.endswith("[secret]") and r.n_chars == len(r.text) and secrets.OWNERS == 2


def test_queries_run(spark, sf_dir):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
