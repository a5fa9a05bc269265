"""Queries over the corpus: chunks, normalisation, counts, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as c
from ..operators.tables import update_where
from .registry import ENGLISH, SPANISH, normalized, query, set_apart, squeezed, stripped, table, western, words

_CHUNKS = f"""chunks as (select doc_id, lang, i as chunk_no, array_to_string(w[10 * i + 1 : 10 * i + 10], ' ') as text
  from (select doc_id, lang, w, unnest(range(0, cast(ceil(len(w) / 10.0) as bigint))) as i from (select doc_id, lang, {words('text')} as w from documents)))"""
_NORMALIZED = f"""{_CHUNKS}, counted as (select lang, text, count(*) as n from chunks group by all),
 normal as (select lang, text, cast(sum(n) as bigint) as occurrence_count from (select lang, {normalized('text', 'lang')} as text, n from counted) where trim(text) <> '' group by all)"""
_WORDS = f"{_NORMALIZED}, freq as (select lang, word, cast(sum(occurrence_count) as bigint) as frequency from (select lang, unnest({words('text')}) as word, occurrence_count from normal) group by all)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk(c.spread(_docs(spark, sf_dir).select("doc_id", "lang", "text")), "text", 10, ("doc_id", "lang"))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.normalized_chunks(chunks(spark, sf_dir))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.normalized_words(chunks(spark, sf_dir))


@query(f"with {_CHUNKS} select doc_id, cast(chunk_no as integer) as chunk_no, text from chunks")
def chunk_words(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_no", "text")


@query(
    f"""with pages as (select conv_id, string_agg(text, ' ' order by turn) as text from conversations group by conv_id), cut as (select conv_id, {words('text')} as w from pages)
select conv_id, cast(i as integer) as chunk_no, array_to_string(w[10 * i + 1 : 10 * i + 10], ' ') as text from (select conv_id, w, unnest(range(0, cast(ceil(len(w) / 10.0) as bigint))) as i from cut)"""
)
def chunk_pages(spark, sf_dir):
    return c.chunk_documents(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"with {_NORMALIZED} select * from normal")
def normalized_chunk_counts(spark, sf_dir):
    return normal(spark, sf_dir)


@query("select lang, text, count(*) as occurrence_count from documents group by all")
def doc_dedup_count(spark, sf_dir):
    return c.dedup_count(_docs(spark, sf_dir), "lang", "text")


@query(f"with {_WORDS} select * from freq")
def word_freq(spark, sf_dir):
    return frequencies(spark, sf_dir)


@query(f"with {_WORDS} select lang, word, frequency, cast(rank as integer) as rank from (select *, row_number() over (partition by lang order by frequency desc, word) as rank from freq) where rank <= 10")
def word_topk_lang(spark, sf_dir):
    return c.top(frequencies(spark, sf_dir), 10, "frequency", "word", "lang")


@query(f"with {_WORDS} select word, frequency from freq where lang = 'en' order by frequency desc, word limit 2000")
def word_top2000(spark, sf_dir):
    return c.top(frequencies(spark, sf_dir).where("lang = 'en'"), 2000, "frequency", "word").select("word", "frequency")


@query(
    f"""with {_WORDS}, t as (select 'words' as kind, word as token, frequency from freq where lang = 'en' order by frequency desc, word limit 2000), s as (select 'syllables' as kind, source as token, count(*) as frequency from documents where lang = 'en' group by source order by frequency desc, token limit 2000),
u as (select * from t union all select * from s) select kind, '{{' || string_agg(cast(to_json(token) as varchar) || ':' || frequency, ',' order by frequency desc, token) || '}}' as exported from u group by kind"""
)
def export_top2000_json(spark, sf_dir):
    """Words, and sources in the place of syllables, which English has none of."""
    s = _docs(spark, sf_dir).groupBy("lang", F.col("source").alias("syllable")).agg(F.count("*").alias("frequency"))
    return c.most_frequent(frequencies(spark, sf_dir), s, "en")


@query("with old as (select lang, text, count(*) as n from documents where doc_id % 2 = 0 group by all), new as (select lang, text, count(*) as n from documents where doc_id % 2 = 1 or doc_id % 3 = 0 group by all) select lang, text, cast(sum(n) as bigint) as n from (select * from old union all select * from new) group by all")
def upsert_accumulate(spark, sf_dir):
    d = _docs(spark, sf_dir)
    part = lambda rows: d.where(rows).groupBy("lang", "text").agg(F.count("*").alias("n"))
    return c.accumulate(part("doc_id % 2 = 0"), part("doc_id % 2 = 1 OR doc_id % 3 = 0"), ["lang", "text"], "n")


@query("select doc_id, 'new' as state, text from documents where doc_id % 2 = 1 or doc_id % 3 = 0 union all select doc_id, 'old' as state, text from documents where doc_id % 2 = 0 and doc_id % 3 <> 0")
def insert_or_replace(spark, sf_dir):
    d = _docs(spark, sf_dir)
    part = lambda rows, s: d.where(rows).select("doc_id", F.lit(s).alias("state"), "text")
    return c.replace_rows(part("doc_id % 2 = 0", "old"), part("doc_id % 2 = 1 OR doc_id % 3 = 0", "new"), ["doc_id"])


@query("select doc_id, case when n_chars < 500 then 'short' else source end as source, case when n_chars < 500 then 0 else n_chars end as n_chars from documents")
def update_predicate(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    return update_where(d, F.col("n_chars") < 500, source=F.lit("short"), n_chars=F.lit(0).cast("long"))


@query("select lang, count(*) as n, count(*) filter (where trim(text) <> '' and n_chars >= 1000) as remaining from documents group by lang")
def remaining_work(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if((F.trim("text") != "") & (F.col("n_chars") >= 1000)).alias("remaining"))


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def resume_antijoin(spark, sf_dir):
    return c.unprocessed(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("select text, min(doc_id) as doc_id from documents group by text")
def ordered_distinct(spark, sf_dir):
    return c.ordered_distinct(_docs(spark, sf_dir), "text", "doc_id")


@query("select 0 as source, doc_id as ord, text from documents union all select 1, item_id, text from benchmark")
def union_texts(spark, sf_dir):
    a = _docs(spark, sf_dir).select(F.lit(0).alias("source"), F.col("doc_id").alias("ord"), "text")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit(1).alias("source"), F.col("item_id").alias("ord"), "text"))


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5('7:' || doc_id), doc_id) as r, floor(count(*) over (partition by lang) * 0.15) as n from documents) where r <= n")
def sample_rows(spark, sf_dir):
    """Exactly int(n * p / 100) rows of each language, by a seeded digest."""
    return c.sample_exact(_docs(spark, sf_dir).select("lang", "doc_id"), 15, "doc_id", 7, ("lang",))


def _one(text: Column, spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """An expression over the text of each document."""
    return c.spread(_docs(spark, sf_dir).where(where).select("doc_id", "lang", "text")).select("doc_id", text.alias("out"))


@query(f"select doc_id, {stripped(squeezed('nfc_normalize(text)'))} as out from documents")
def wordify_universal(spark, sf_dir):
    return _one(tx.wordify_universal(F.col("text")), spark, sf_dir)


@query(f"select doc_id, lower({stripped(squeezed('nfc_normalize(text)'))}) as out from documents")
def norm_universal(spark, sf_dir):
    return _one(tx.normalize_universal(F.col("text")), spark, sf_dir)


@query(f"select doc_id, {western('text', '', ENGLISH)} as out from documents where lang = 'en'")
def norm_en(spark, sf_dir):
    return _one(tx.normalize_english(F.col("text")), spark, sf_dir, "lang = 'en'")


@query(f"select doc_id, {western('text', '¿¡', SPANISH)} as out from documents where lang = 'es'")
def norm_es(spark, sf_dir):
    return _one(tx.normalize_spanish(F.col("text")), spark, sf_dir, "lang = 'es'")


@query(f"select doc_id, {normalized('text', 'lang')} as out from documents")
def norm_routed(spark, sf_dir):
    return _one(c.normalize(F.col("text"), F.col("lang")), spark, sf_dir)


@query(f"select doc_id, {stripped(squeezed("replace(replace(replace(replace(text, 'Dr.', 'Doctor'), 'Mr.', 'Mister'), 'St.', 'Street'), '$', ' dollars ')"))} as out from documents where lang = 'en'")
def wordify_en(spark, sf_dir):
    return _one(tx.wordify_english(F.col("text"), True), spark, sf_dir, "lang = 'en'")


@query(f"select doc_id, {stripped(squeezed("replace(replace(replace(replace(replace(replace(replace(text, 'Sr.', 'Señor'), 'Sra.', 'Señora'), 'Dr.', 'Doctor'), 'Dra.', 'Doctora'), 'Av.', 'Avenida'), '$', ' dólares '), '€', ' euros ')"))} as out from documents where lang = 'es'")
def wordify_es(spark, sf_dir):
    return _one(tx.wordify_spanish(F.col("text"), True), spark, sf_dir, "lang = 'es'")


@query("select doc_id, array_to_string(list_filter(string_split(replace(text, ' ', ''), ''), lambda c: c <> ''), ' ') as out from documents")
def graphemes(spark, sf_dir):
    return _one(tx.graphemes(F.col("text")), spark, sf_dir)


@query(f"select doc_id, cast(len({words('text')}) as integer) as n_words, {words('text')}[1] as first_word from documents")
def word_list(spark, sf_dir):
    w = tx.words(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(w).alias("n_words"), F.try_element_at(w, F.lit(1)).alias("first_word"))


@query(f"select doc_id, {set_apart('text')} as out from documents")
def punctuation_set_apart(spark, sf_dir):
    return _one(tx.set_apart(F.col("text")), spark, sf_dir)


@query("select doc_id, replace(text, '\"', '') as out from documents")
def quotes_removed(spark, sf_dir):
    return _one(tx.without_quotes(F.col("text")), spark, sf_dir)


@query("select conv_id, count(*) as n_turns, string_agg(text, ' ' order by turn) as text from conversations group by conv_id")
def transcript(spark, sf_dir):
    from ..operators.dataset import concat_turns

    return concat_turns(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


_TURNS = f"select conv_id, turn, {stripped('text')} as text from conversations"


@query(f"with t as ({_TURNS}) select conv_id, string_agg({western('text', '', ENGLISH)}, chr(10) order by turn) as text from t where text <> '' group by conv_id")
def transcript_normalized(spark, sf_dir):
    """Segments normalised, a line each."""
    return c.transcript(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", tx.normalize_english, False)


@query(f"with t as ({_TURNS}) select conv_id, string_agg({stripped(squeezed("replace(text, '$', ' dollars ')"))}, ' ' order by turn) as text from t where text <> '' group by conv_id")
def transcript_wordified(spark, sf_dir):
    """Segments with words for signs, as one paragraph."""
    return c.transcript(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", tx.wordify_english)


@query(f"select doc_id, {normalized('text', 'lang')} as normal, array_to_string({words(f"case lang when 'en' then {stripped(squeezed("replace(text, '$', ' dollars ')"))} when 'es' then {stripped(squeezed("replace(replace(text, '$', ' dólares '), '€', ' euros ')"))} else {stripped(squeezed('nfc_normalize(text)'))} end")}, ', ') as words from documents")
def tester(spark, sf_dir):
    """What the testers of the rules show."""
    normal, listed = c.tested(F.col("text"), F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", normal.alias("normal"), listed.alias("words"))
