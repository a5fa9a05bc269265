"""Building a corpus: chunks, weighted frequencies, rankings, and the table operations around them.

Words and syllables are expanded from distinct texts and carry their counts as weights, so the costly rules see each text once;
counts are partial before they are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import syllables as sy
from ..functions import text as tx
from ..functions import turkish as tr


def spread(frame: DataFrame) -> DataFrame:
    """frame in as many partitions as there are cores at least: a file of few row groups would leave costly rules to few tasks. Input that
    is large enough to be read in more parts stays as it is read."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    few = not frame.isStreaming and frame.rdd.getNumPartitions() < cores
    return frame.repartition(cores, F.xxhash64(*frame.columns)) if few else frame  # by digest, as dealing round would sort rows first


def once(value: Column) -> Column:
    """value as a row of its own, so that no condition on it moves below, where it would be computed again."""
    return F.explode(F.array(value))


def chunks_of(words: Column, size: int) -> Column:
    """Groups of `size` words, joined by a space."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n, F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def chunk(docs: DataFrame, text: str, size: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row (keep, chunk_no, text) for each chunk."""
    split = docs.select(*keep, tx.words(F.col(text)).alias("_words"))  # a column, as a lambda would cut the text again for each chunk
    return split.select(*keep, F.posexplode(chunks_of(F.col("_words"), size)).alias("chunk_no", "text"))


def chunk_documents(pages: DataFrame, doc: str, page: str, text: str, size: int = 10) -> DataFrame:
    """Chunks that run on over the pages of a document, in page order."""
    whole = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_pages"))
    return chunk(whole.select(doc, F.array_join(F.transform("_pages", lambda x: x[text]), " ").alias(text)), text, size, (doc,))


#: language: (normalizer, wordifier). What is not here falls back to the universal rules.
LANGUAGES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {}


def register_language(code: str, normalizer: Callable[[Column], Column], wordifier: Callable[[Column], Column]) -> None:
    LANGUAGES[code.lower()] = (normalizer, wordifier)


register_language("tr", tr.normalize, tr.wordify)
register_language("en", tx.normalize_english, tx.wordify_english)
register_language("es", tx.normalize_spanish, tx.wordify_spanish)


def _route(which: int, text: Column, lang: Column, fallback: Callable[[Column], Column]) -> Column:
    """Rules see the texts of their language only, as what they do outside of the JVM is done for every row that is not null."""
    code = F.lower(lang)
    others = fallback(F.when(~F.coalesce(code, F.lit("")).isin(list(LANGUAGES)), text))
    out = None
    for name, rules in LANGUAGES.items():
        made = rules[which](F.when(code == name, text))
        out = F.when(code == name, made) if out is None else out.when(code == name, made)
    return others if out is None else out.otherwise(others)


def normalize(text: Column, lang: Column) -> Column:
    return _route(0, text, lang, tx.normalize_universal)


def wordify(text: Column, lang: Column) -> Column:
    return _route(1, text, lang, tx.wordify_universal)


def dedup_count(texts: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """(keys, occurrence_count)."""
    count = F.count("*") if weight is None else F.sum(weight)
    return texts.groupBy(*keys).agg(count.cast("long").alias("occurrence_count"))


def normalized_chunks(chunks: DataFrame, lang: str = "lang", text: str = "text", count: str | None = None) -> DataFrame:
    """(lang, text, occurrence_count): each distinct chunk is normalised once."""
    distinct = dedup_count(chunks, lang, text, weight=F.col(count) if count else None)
    made = distinct.select(lang, once(normalize(F.col(text), F.col(lang))).alias(text), "occurrence_count").where(F.trim(text) != "")
    return dedup_count(made, lang, text, weight=F.col("occurrence_count"))


def normalized_words(chunks: DataFrame, lang: str = "lang", text: str = "text", within: bool = True) -> DataFrame:
    """(lang, word, frequency), or (word, frequency) of all languages, of chunks as they come, each a row for every time it occurs: what word_frequency makes of normalized_chunks, but
    chunks are normalised where they lie and only counts of words are dealt out. Chunks hardly repeat, so dealing them out, before and
    after, would send the whole text twice."""
    made = chunks.select(lang, once(normalize(F.col(text), F.col(lang))).alias(text))
    keys = [lang, "word"] if within else ["word"]
    return made.select(lang, F.explode(tx.words(F.col(text))).alias("word")).groupBy(*keys).agg(F.count("*").alias("frequency"))


def word_frequency(chunks: DataFrame, lang: str = "lang", text: str = "text", count: str = "occurrence_count") -> DataFrame:
    """(lang, word, frequency), weighted by how often a chunk occurs."""
    return chunks.select(lang, F.explode(tx.words(F.col(text))).alias("word"), count).groupBy(lang, "word").agg(F.sum(count).cast("long").alias("frequency"))


def syllable_frequency(words: DataFrame, lang: str = "lang", word: str = "word", count: str = "frequency") -> DataFrame:
    """(lang, syllable, frequency) of Turkish words; each distinct word is cut once. Other languages have no syllables."""
    turkish = words.where(F.lower(F.col(lang)) == "tr").groupBy(lang, word).agg(F.sum(count).alias("_n"))
    clean = turkish.select(lang, once(sy.clean(F.col(word))).alias("_c"), "_n")
    return clean.select(lang, F.explode(sy.corpus_syllables(F.col("_c"))).alias("syllable"), "_n").groupBy(lang, "syllable").agg(F.sum("_n").cast("long").alias("frequency"))


def top(frame: DataFrame, n: int, by: str, tie: str, *within: str) -> DataFrame:
    """The n rows of the highest `by`, ties by ascending `tie`; of each group if there are any. The limit applies before the shuffle."""
    if not within:
        return frame.orderBy(F.desc(by), F.asc(tie)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), F.asc(tie)))
    return frame.withColumn("rank", rank).where(F.col("rank") <= n)


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    """An upsert that adds: what both hold has the sum."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).cast("long").alias(count))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key is new are replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def unprocessed(new: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    return new.join(done, key, "left_anti")


def ordered_distinct(frame: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, at its first place."""
    return frame.groupBy(value).agg(F.min(order).alias(order))


def sample_exact(frame: DataFrame, percent: float, key: str, seed: int = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """int(n * percent / 100) rows of each group, the smallest of a seeded digest of the key.

    Digests are counted by their first four digits, a partial count, so that only the rows of one in 65,536 of them are ranked: those
    before are all taken, those behind are not.
    """
    made = frame.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_bucket", F.substring("_digest", 1, 4))
    counts = made.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket")
    counts = counts.withColumn("_upto", F.sum("_n").over(before)).withColumn("_wanted", F.floor(F.sum("_n").over(Window.partitionBy(*within)) * percent / 100))
    edges = counts.where("_upto - _n < _wanted").select(*[F.col(c).alias(f"_of_{c}") for c in within], F.col("_bucket").alias("_of"), F.greatest(F.lit(0), F.least("_n", F.col("_wanted") - (F.col("_upto") - F.col("_n")))).alias("_take"), (F.col("_upto") > F.col("_wanted")).alias("_edge"))
    same = F.col("_bucket") == F.col("_of")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    found = made.join(edges, same)
    rank = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_digest", key))
    whole, part = found.where("NOT _edge"), found.where("_edge").withColumn("_rank", rank).where("_rank <= _take").drop("_rank")
    return whole.unionByName(part).select(*frame.columns)


def one_per_group(frame: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """A row of each group, that of the smallest seeded digest of its key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rest = [c for c in frame.columns if c != group]
    return frame.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(digest.alias("d"), key)).alias("_r")).select(group, "_r.*")


def transcript(segments: DataFrame, by: list[str], order: str, text: str, rule: Callable[[Column], Column], paragraph: bool = True) -> DataFrame:
    """(by, text): segments in order, stripped, without blank ones, each by the rule; joined by a space or as lines."""
    said = segments.select(*by, order, tx.strip(F.col(text)).alias(text)).where(F.col(text) != "").withColumn(text, rule(F.col(text)))
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return said.groupBy(*by).agg(listed.alias("_t")).select(*by, F.array_join(F.transform("_t", lambda x: x[text]), " " if paragraph else "\n").alias(text))


def tested(text: Column, lang: Column, upper: bool = False) -> tuple[Column, Column]:
    """What the testers show: the normalised text, and its words joined by commas."""
    normal = normalize(text, lang)
    return (F.upper(normal) if upper else normal), F.array_join(tx.words(wordify(text, lang)), ", ")


def most_frequent(words: DataFrame, syllables: DataFrame, lang: str, n: int = 2000) -> DataFrame:
    """(kind, exported): the n most frequent words and syllables of a language as JSON objects, in the order of their ranks."""
    every = words.select(F.lit("words").alias("kind"), "lang", F.col("word").alias("token"), "frequency").unionByName(syllables.select(F.lit("syllables").alias("kind"), "lang", F.col("syllable").alias("token"), "frequency"))
    ranked = top(every.where(F.col("lang") == lang), n, "frequency", "token", "kind")
    listed = F.array_sort(F.collect_list(F.struct("rank", "token", "frequency")))  # n at most
    quoted = lambda x: F.substring(F.to_json(F.array(x["token"])), 2, 1 << 30)  # noqa: E731 - "token"], escaped as JSON has it
    entry = lambda x: F.concat(F.regexp_replace(quoted(x), r"\]$", ""), F.lit(":"), x["frequency"].cast("string"))
    return ranked.groupBy("kind").agg(listed.alias("x")).select("kind", F.concat(F.lit("{"), F.array_join(F.transform("x", entry), ","), F.lit("}")).alias("exported"))
