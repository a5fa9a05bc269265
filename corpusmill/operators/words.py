"""Words and texts as speech: rhymes, exceptions of stress, coverage by phonemes, batches of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonemes as ph
from ..functions import syllables as sy
from ..session import settled
from .corpus import once


def rhymes(targets: DataFrame, candidates: DataFrame, word: str = "word", least: int = 1) -> DataFrame:
    """(word, rhyme, matching, rank): for each target the candidates that share `least` syllables or more at the end, best first, then
    in order. Words that share any share the last one, which is the join's key; a word is no rhyme of itself, in whatever case."""
    cut = lambda frame, name: frame.select(F.col(word).alias(name), once(sy.syllables(F.col(word))).alias(f"_{name}")).where(F.size(f"_{name}") > 0).withColumn("_last", F.element_at(f"_{name}", -1))
    pairs = cut(candidates, "rhyme").join(cut(targets, "word"), "_last").where(F.lower("word") != F.lower("rhyme"))
    found = pairs.select("word", "rhyme", sy.matching_end(F.col("_word"), F.col("_rhyme")).alias("matching")).where(F.col("matching") >= least)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("matching"), "rhyme")))


def best_rhymes(vocabulary: DataFrame, k: int = 10, word: str = "word") -> DataFrame:
    """(word, rhyme, matching, rank): the k best rhymes of every word among all words, ranked as rhymes() does.

    A word looks at its longest tail first, and at a shorter one only while longer ones leave it short of k. What it looks at is a list:
    of the words with a tail, at most 2k, at most k of which go on with one syllable before the tail. As a word leaves out just those
    that go on as it does itself, which its longer tail has dealt with, k others are always left. No pairs are formed within a tail.
    """
    cut = vocabulary.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct().withColumn("s", once(sy.syllables(F.col("word")))).where(F.size("s") > 0)
    cut = settled(cut)  # read for tails, their kinds, and lists
    n = F.size("s")
    each = cut.select("word", n.alias("n"), "s", F.explode(F.sequence(F.lit(1), n)).alias("matching"))
    tail = F.array_join(F.slice("s", -F.col("matching"), F.col("matching")), "-")
    before = F.when(F.col("n") > F.col("matching"), F.concat(F.lit("-"), F.element_at("s", -(F.col("matching") + 1)))).otherwise(F.lower("word"))
    tails = each.select("word", "matching", tail.alias("tail"), before.alias("before"))
    kinds = tails.groupBy("tail", "before").agg(F.count("*").alias("alike"))
    sizes = kinds.groupBy("tail").agg(F.sum("alike").alias("all")).where("all > 1")
    longer = Window.partitionBy("word").orderBy(F.desc("matching")).rowsBetween(Window.unboundedPreceding, -1)
    others = tails.join(sizes, "tail").join(kinds, ["tail", "before"]).withColumn("others", F.col("all") - F.col("alike"))
    asked = others.withColumn("had", F.coalesce(F.sum("others").over(longer), F.lit(0))).where((F.col("had") < k) & (F.col("others") > 0))
    few = tails.withColumn("r", F.row_number().over(Window.partitionBy("tail", "before").orderBy("word"))).where(F.col("r") <= k)
    lists = few.withColumn("r", F.row_number().over(Window.partitionBy("tail").orderBy("word"))).where(F.col("r") <= 2 * k)
    found = asked.select("word", "matching", "tail", "before").join(lists.select("tail", F.col("before").alias("_b"), F.col("word").alias("rhyme")), "tail").where(F.col("before") != F.col("_b"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("matching"), "rhyme"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("word", "rhyme", "matching", "rank")


def valid_exceptions(exceptions: DataFrame, word: str = "word", position: str = "position") -> DataFrame:
    """(word, position) of the exceptions whose word has the syllable, as they are kept; of several for a word the largest."""
    valid = exceptions.where(sy.valid_exception(F.col(word), F.col(position)))
    return valid.groupBy(sy.exception_word(F.col(word)).alias("word")).agg(F.max(position).alias("position"))


def merged_exceptions(old: DataFrame, new: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The old ones, replaced by new ones of the same word, without removed words; all are (word, position)."""
    both = old.select("word", "position", F.lit(0).alias("_new")).unionByName(new.select("word", "position", F.lit(1).alias("_new")))
    last = F.max("_new").over(Window.partitionBy("word"))  # new ones are many, and are found once
    kept = both.withColumn("_last", last).where((F.col("_new") == F.col("_last")) | F.col("word").isNull()).select("word", "position")
    return kept if removed is None else kept.join(removed.select(sy.exception_word(F.col("word")).alias("word")).distinct(), "word", "left_anti")


def stressed_by(words: DataFrame, exceptions: DataFrame, word: str = "word") -> DataFrame:
    """(word, position) of words under a table of exceptions of any size."""
    parts = words.select(F.col(word).alias("word"), sy.syllables(F.col(word)).alias("_s"), sy.exception_word(F.trim(F.col(word))).alias("_e"))
    joined = parts.join(exceptions.select(F.col("word").alias("_e"), F.col("position").alias("_p")), "_e", "left")
    plain = sy.stress_index(F.col("_s"), F.col("word"), {})
    last = F.try_element_at("_s", F.lit(-1))
    listed = (F.size("_s") > 1) & ~last.isin(sy.QUESTION) & (F.col("_p") >= 0) & (F.col("_p") < F.size("_s"))
    return joined.select("word", F.when(listed, F.col("_p")).otherwise(plain).alias("position"))


def phoneme_coverage(texts: DataFrame, text: str, normalized: bool = True) -> DataFrame:
    """One row: how many texts and phonemes, how many of the vocabulary's occur, and how many are unknown. Ratios are 0 without any."""
    size = len(ph.VOCABULARY)
    ids = texts.select(F.explode(ph.text_to_ids(F.col(text), normalized=normalized)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    total, unknown = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id") == ph.UNKNOWN, F.col("n"))), F.lit(0))
    found = ids.agg(total.alias("total_phonemes"), F.count("*").alias("unique_phonemes"), F.lit(size).alias("vocab_size"), (F.count("*") / size).alias("coverage"), unknown.alias("unknown"), F.when(total > 0, unknown / total).otherwise(0.0).alias("unknown_ratio"))
    return texts.agg(F.count("*").alias("total_texts")).crossJoin(found)  # a row each


def batch_encode(texts: DataFrame, text: str, keep: tuple[str, ...], frame: bool = False, normalized: bool = True, longest: int | None = None) -> DataFrame:
    """(keep, ids, mask): ids padded to the longest of all, or cut and padded to the given length."""
    rows = texts.select(*keep, ph.text_to_ids(F.col(text), frame, normalized).alias("ids"))
    if longest is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.max(F.size("ids")), F.lit(0)).alias("_n"))))  # one row
    padded = rows.select(*keep, ph.pad(F.col("ids"), F.col("_n") if longest is None else F.lit(longest)).alias("ids"))
    return padded.withColumn("mask", ph.mask(F.col("ids")))
