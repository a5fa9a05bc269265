"""Queries of tokenizer vocabularies: symbols, training input, merges, pieces, special tokens, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as c
from ..operators import dataset as ds
from ..operators import vocab as v
from ..session import delete, own_folder, settled
from ..sources import model_file
from .corpus import _CHUNKS, _NORMALIZED, _WORDS, chunks, normal
from .registry import met, met_sql, normalized, query, table, words
from .turkish import _SYLLABLES


_UPPER = v.forced_symbols(["zh", "en", "tr", "es"], upper=True)


@query(met_sql(_UPPER, "piece"))
def forced_symbols_upper(spark, sf_dir):
    """The same in capitals."""
    return met(spark, sf_dir, _UPPER, "piece")


@query("with t as (select 'unk_token' as name, '<unk>' as token, 2 as id union all select 'pad_token', null, -1 union all select 'bos_token', '<s>', 0 union all select 'eos_token', '</s>', 1), d as (select cast(doc_id % 4 as integer) as id, count(*) as n from documents where text is not null group by 1) select name, token, t.id, case when token is null then 0 else coalesce(n, 0) end as n from t left join d on d.id = t.id")
def special_tokens(spark, sf_dir):
    """The special tokens, and how many texts would get each at their end, dealt by number."""
    tokens = spark.createDataFrame([(k, t, v.SPECIAL_IDS[f"{k}_id"]) for k, t in v.SPECIAL_TOKENS.items()], "name string, token string, id int")
    ends = table(spark, sf_dir, "documents").where("text is not null").groupBy((F.col("doc_id") % 4).cast("int").alias("id")).agg(F.count("*").alias("n"))
    return tokens.join(ends, "id", "left").select("name", "token", "id", F.when(F.col("token").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n"))


_RANKED = "select piece, row_number() over (order by frequency desc, piece) - 1 as r from"


@query(
    f"""{_SYLLABLES}, freq as (select word, count(*) as n from (select unnest({words('text')}) as word from documents) group by word),
pieces as (select n, unnest(list_transform(s, lambda x, i: case when i = 1 then '▁' || x else x end)) as piece from syl join freq using (word)),
merged as ({_RANKED} (select piece, sum(n) as frequency from pieces where piece <> '' group by piece) qualify r < 1000 union all select piece, r + 1000 from ({_RANKED} (select word as piece, n as frequency from freq) qualify r < 1000))
select cast(min(r) as integer) as ord, piece from merged group by piece"""
)
def corpus_forced_pieces(spark, sf_dir):
    """The most frequent syllables and words that a corpus tokenizer must hold, with every word read as Turkish."""
    w = table(spark, sf_dir, "documents").select(F.lit("tr").alias("lang"), F.explode(tx.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("frequency"))
    return v.forced_pieces(c.syllable_frequency(w), w, "tr", 1000)


@query(
    f"""with {_CHUNKS}, counted as (select lang, text, min(doc_id * 100000 + chunk_no) as o from chunks where lang = 'en' group by all), corpus as (select 1 as source, o, text from (select min(o) as o, {normalized('text', 'lang')} as text from counted group by all)),
lines as (select 0 as source, item_id as o, {normalized('text', "'en'")} as text from benchmark), merged as (select * from lines union all select * from corpus), one as (select text, min(struct_pack(source := source, o := o)) as f from merged where trim(text) <> '' group by text)
select cast(f.source as integer) as source, f.o as ord, text from one"""
)
def training_lines(spark, sf_dir):
    """What a tokenizer is trained on: lines of metadata, normalised, and the corpus' chunks, each text once."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    made = chunks(spark, sf_dir).where("lang = 'en'").groupBy("lang", "text").agg(F.min(F.col("doc_id") * 100000 + F.col("chunk_no")).alias("ord"))
    corpus = made.select("ord", c.normalize(F.col("text"), F.col("lang")).alias("text")).groupBy("text").agg(F.min("ord").alias("ord"))
    return ds.training_lines(lines, corpus, lambda t: c.normalize(t, F.lit("en")))


#: Merges of the queries that SQL stands beside, which passes over all words for each; and of the one that tests hold against plain loops.
MERGES, MANY = 60, 2000
_STEPS = f"""with recursive {_WORDS}, w0 as materialized (select word, regexp_replace('▁' || word, '(.)', ' \\1 ', 'g') as s, cast(sum(frequency) as bigint) as frequency from freq group by word),
t(i, word, s, frequency, a, b, n) as (select 0, word, s, frequency, '', '', 0::bigint from w0 union all
 select t.i + 1, word, replace(s, ' ' || m.a || '  ' || m.b || ' ', ' ' || m.a || m.b || ' '), frequency, m.a, m.b, m.n from t,
 (select p[1] as a, p[2] as b, cast(sum(frequency) as bigint) as n from (select unnest(list_zip(x[:-2], x[2:])) as p, frequency from (select string_split(trim(s), '  ') as x, frequency from t) where len(x) > 1) group by all order by n desc, a, b limit 1) m where t.i < {MERGES}),
merges as (select i - 1 as rank, any_value(a) as a, any_value(b) as b, any_value(n) as n from t where i > 0 group by i)"""


def _vocabulary(spark, sf_dir):
    return c.normalized_words(chunks(spark, sf_dir), within=False)


@query(f"{_STEPS} select rank, a, b, n from merges")
def bpe_train(spark, sf_dir):
    found = v.train_pairs(_vocabulary(spark, sf_dir), MERGES)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(found)], "rank int, a string, b string, n long")


@query(f"{_STEPS}, x as (select word, string_split(trim(s), '  ') as x from t where i = {MERGES}) select word, array_to_string(x, ' ') as pieces, replace(array_to_string(x, ''), '▁', '') as decoded, cast(len(x) as integer) as n from x")
def bpe_encode(spark, sf_dir):
    """Every distinct word in the pieces of the trained merges, and back."""
    w = settled(_vocabulary(spark, sf_dir))
    merges = [(a, b) for a, b, _ in v.train_pairs(w, MERGES)]
    out = w.select("word", v.encode(F.col("word"), merges).alias("x"))
    return out.select("word", F.array_join("x", " ").alias("pieces"), v.decode(F.col("x")).alias("decoded"), F.size("x").alias("n"))


_LISTED = f"""{_STEPS}, firsts as (select piece, min(o) as o from (select a || b as piece, rank + 3 as o from merges union all select unnest(['<s>', '</s>', '<unk>']), unnest([0, 1, 2])) group by piece), listed as (select piece, row_number() over (order by o) - 1 as id from firsts),
ch as (select piece, sum(frequency) as n from (select unnest(list_filter(string_split('▁' || word, ''), lambda x: x <> '')) as piece, frequency from w0) where piece not in (select piece from listed) group by piece),
every as (select id, piece from listed union all select row_number() over (order by n desc, piece) - 1 + (select count(*) from listed), piece from ch)"""


@query(f"{_LISTED} select cast(id as integer) as id, piece, case when id < 3 then 0.0 else cast(3 - id as double) end as score from every")
def bpe_vocabulary(spark, sf_dir):
    w = settled(_vocabulary(spark, sf_dir))
    return v.trained_vocabulary(w, v.train_pairs(w, MERGES), [])


@query(f"{_LISTED} select cast(id as integer) as id, piece, cast(case when id < 3 then 0.0 else 3 - id end as float) as score, case when piece = '<unk>' then 2 when piece in ('<s>', '</s>') then 3 else 1 end as type from every")
def bpe_model_file(spark, sf_dir):
    """The trained vocabulary as a .model file, read back."""
    w = settled(_vocabulary(spark, sf_dir))
    rows = v.trained_vocabulary(w, v.train_pairs(w, MERGES), []).withColumn("type", model_file.kind(F.col("piece")))
    folder = own_folder(spark, "model")
    try:
        model_file.write_model(rows, f"{folder}/trained.model")
        return settled(model_file.read_models(spark, f"{folder}/trained.model").drop("path"))
    finally:
        delete(spark, folder)


@query()
def bpe_ids(spark, sf_dir):
    """Every distinct word as the ids of a vocabulary of 2,000 merges, and back from the ids."""
    w = settled(_vocabulary(spark, sf_dir))
    merges = v.train_pairs(w, MANY)
    ids = v.trained_vocabulary(w, merges, []).select("id", "piece")
    each = w.select("word", F.posexplode(v.encode(F.col("word"), [m[:2] for m in merges])).alias("at", "piece"))
    listed = F.array_sort(F.collect_list(F.struct("at", "id", "piece")))
    out = each.join(ids, "piece").groupBy("word").agg(listed.alias("x"))
    return out.select("word", F.transform("x", lambda x: x["id"]).alias("ids"), v.decode(F.transform("x", lambda x: x["piece"])).alias("decoded"))


@query(f"with w as (select item_id, {words('text')} as w from benchmark) select item_id, array_to_string(list_transform(w, lambda x: '[' || length(x) || '] ▁' || x), ' | ') as report, cast(len(w) as integer) as n from w")
def token_report(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", tx.words(F.col("text")).alias("w"))
    return w.select("item_id", v.token_report(F.transform("w", F.length), F.transform("w", lambda x: F.concat(F.lit(v.MARK), x))).alias("report"), F.size("w").alias("n"))


@query(f"with {_NORMALIZED} select lang, count(*) as n, cast(sum(length(text)) as bigint) as characters from normal group by lang")
def corpus_text_sizes(spark, sf_dir):
    return normal(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("characters"))
