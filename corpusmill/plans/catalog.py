"""Queries of listings, choices and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import syllables as sy
from ..functions import text as tx
from ..operators import catalog as cat
from ..session import settled
from .registry import met, met_sql, query, table
from .turkish import _BACK, _STRESS, _SYLLABLES, _V, _vocab


def _named(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, cat.CHECKPOINTS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("run"), F.when(F.col("doc_id") % 5 == 0, "other.pth").otherwise(name).alias("name")).distinct()


_NAMES = "[" + ", ".join(f"'{c}'" for c in cat.CHECKPOINTS) + "]"


@query(f"with f as (select distinct source || '/' || lang as run, case when doc_id % 5 = 0 then 'other.pth' else {_NAMES}[doc_id % 4 + 1] end as name from documents) select run, arg_min(name, list_position({_NAMES}, name)) as name from f where name <> 'other.pth' group by run")
def checkpoint_preference(spark, sf_dir):
    return cat.preferred(_named(spark, sf_dir), "run", "name", cat.CHECKPOINTS)


@query("select doc_id, case when doc_id % 4 = 0 then 'v/' || doc_id || '.npy' when doc_id % 4 = 1 then 'm/' || doc_id || '.npy' else doc_id || '.npy' end as resolved from documents")
def path_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".npy"))
    held = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("v/"), name), F.concat(F.lit("m/"), name))).when(F.col("doc_id") % 4 == 1, F.array(F.concat(F.lit("m/"), name)))
    files = d.select(F.explode(held).alias("path"))
    return cat.first_existing(d, "doc_id", [F.concat(F.lit("v/"), name), F.concat(F.lit("m/"), name)], files, "path", name)


@query("select lang, case lang when 'en' then 'a,b' when 'de' then 'c' else 'google/fleurs' end as datasets, case lang when 'es' then 'es_419' else lang end as subset from (select distinct lang from documents)")
def dataset_catalogue(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang").distinct()
    return d.select("lang", F.array_join(cat.datasets_of(F.col("lang"), {"en": ["a", "b"], "de": ["c"]}), ",").alias("datasets"), cat.subset_of(F.upper("lang"), {"es": "es_419"}).alias("subset"))


@query("select distinct lang as language from documents")
def locale_discovery(spark, sf_dir):
    return cat.locales(table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("_"), "source", F.lit(".json")).alias("name")), "name")


@query("select string_agg(distinct source || '.pth', chr(10) order by source || '.pth') as listing from documents")
def file_listing(spark, sf_dir):
    return cat.listed(table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".pth")).alias("name")).distinct(), "name", ".PTH")


@query("select doc_id from documents where doc_id % 3 <> doc_id % 2")
def tokenizer_guard(spark, sf_dir):
    path = lambda k, sep: F.concat(F.lit(f"a{sep}b{sep}bpe"), (F.col("doc_id") % k).cast("string"), F.lit(".model"))
    runs = table(spark, sf_dir, "documents").select("doc_id", path(3, "/").alias("used"), path(2, "\\").alias("wanted"))
    return cat.mismatched(runs, "used", "wanted").select("doc_id")


_ROWS = "rows_ as (select o_orderkey as r, o_totalprice as w, o_orderpriority as p, (select count(*) from orders) as n from orders)"


@query(f"with {_ROWS} select case when n <= 4000 or r < 2200 then r else r - 10201 + 2200 end as row, w from rows_ where case when n <= 4000 then r < 4000 else r < 2200 or r between 10201 and 12000 end")
def embedding_resize(spark, sf_dir):
    """Orders as the rows of a weight table, for a vocabulary of 4,000."""
    return cat.resized(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("w")), 4000)


@query(f"with {_ROWS} select r - 10200 + 2200 as id, p || r as piece from rows_ where r between 10201 and 11999")
def english_block(spark, sf_dir):
    """Orders as the pieces of a full vocabulary, of which the English block moves."""
    pieces = F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    return cat.english_block(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pieces.alias("piece")), 4000)


@query(f"select ord::bigint as place, genre, n from ({met_sql(sorted(cat.GENRES), 'genre')})")
def genres(spark, sf_dir):
    """The genres in order, and how many documents name each."""
    return met(spark, sf_dir, sorted(cat.GENRES), "genre").select(F.col("ord").cast("long").alias("place"), "genre", "n")


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('漢' || text || '字 ' || lang, '([ᄀ-ᇿ⺀-꓏ꡀ-힯豈-﫿︰-﹏･-ￜ𠀀-𯿿])', ' \\1 ', 'g'), '\\s+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') as out from documents")
def cjk_spacing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.isolate_cjk(F.concat(F.lit("漢"), "text", F.lit("字 "), "lang")).alias("out"))


_FIRST = f"case when not regexp_matches(lower(WORD), '{_V}') then null when regexp_matches(regexp_extract(lower(WORD), '{_V}'), '[{sy.FRONT}]') then 'front' else 'back' end"
_WHOLE = f"(length(regexp_replace(lower(WORD), '[^{sy.FRONT}]', '', 'g')) > 0) <> (length(regexp_replace(lower(WORD), '[^{_BACK}]', '', 'g')) > 0)"


@query(
    f"""{_SYLLABLES}, w as (select word, s, cast({_STRESS} as integer) as at, {_FIRST.replace('WORD', 'word')} as first, {_WHOLE.replace('WORD', 'word')} as whole, row_number() over (order by word) as k from syl)
select a.word as word1, b.word as word2, array_to_string(a.s, '-') as syllables1, array_to_string(b.s, '-') as syllables2, len(a.s) = len(b.s) as same_syllable_count, cast(abs(len(a.s) - len(b.s)) as integer) as syllable_count_diff, a.at as stress_position1, b.at as stress_position2,
a.at is not distinct from b.at as same_stress_pattern, a.whole and b.whole as both_harmonic, a.first is not distinct from b.first as same_vowel_type from w a join w b on b.k = a.k + 1"""
)
def compare_words(spark, sf_dir):
    """Neighbours in the alphabet: their syllables, stress and vowels."""
    from ..operators.vocab import numbered

    cut = numbered(_vocab(spark, sf_dir), F.col("word")).withColumn("s", sy.syllables(F.col("word")))
    w = settled(cut.select("place", "word", sy.traits(F.col("word"), F.col("s")).alias("t")))  # both sides of the join read it
    b = w.select((F.col("place") - 1).alias("place"), F.col("word").alias("word2"), F.col("t").alias("u"))
    out = w.join(b, "place").select(*sy.compared(F.col("word"), F.col("word2"), F.col("t"), F.col("u")))
    return out.withColumns({n: F.array_join(n, "-") for n in ("syllables1", "syllables2")})
