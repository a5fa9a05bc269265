"""Quotes of few words, and of scripts without spaces, link as others do."""

from pyspark.sql import functions as F

from corpusmill.llm import quotes


def test_short_quotes_link(spark):
    rows = [(1, 0, "user", "ok"), (1, 1, "assistant", "> ok\nfine"), (1, 2, "user", "> Fine\nYes, agreed"), (1, 3, "assistant", "> Yes, agreed\nthanks"), (2, 0, "user", "这是一个很长的中文句子没有空格"), (2, 1, "assistant", "> 这是一个很长的中文句子没有空格\n好"), (2, 2, "user", "> 好\nอืม"), (3, 0, "user", "hm\nThe second line of it"), (3, 1, "user", "a\nsome other thing"), (3, 2, "user", "> The second line of it\n> a\nx"), (3, 3, "user", "> hm\ny"), (3, 4, "user", ">\nz")]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(0))).collect()}
    assert [got[1, t].answers for t in range(4)] == [None, 0, 1, 2]
    assert [got[2, t].answers for t in range(3)] == [None, 0, 1]
    assert [got[3, t].answers for t in range(5)] == [None, None, 0, 0, None]  # "a" alone does not draw a longer quote to it
    assert (got[1, 3].thread, got[1, 3].depth) == (0, 3)
