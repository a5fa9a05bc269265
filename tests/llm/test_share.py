"""The share of hit words from which a document is contaminated is the one that is asked for."""

import pytest

from corpusmill.llm import decontam


@pytest.mark.parametrize(("least", "hits"), [(0.3, 3), (0.05, 1), (0.35, 4), (0.5, 5), (1.0, 10), (0.7, 7)])
def test_share(spark, least, hits):
    """Ten words, of which the first 1, 2, ... are an item's."""
    docs = [(n, " ".join([f"i{n}x{k}" for k in range(n)] + [f"d{k}" for k in range(10 - n)])) for n in range(11)]
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 11)]
    out = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least)
    assert {r.doc_id: r.contaminated for r in out.collect()} == {n: n >= hits for n in range(11)}
