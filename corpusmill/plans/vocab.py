"""Queries of the vocabulary operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as c
from ..operators import vocab as v
from .corpus import _WORDS, frequencies
from .registry import SQL, met, met_sql, query, table, words

_FORCED = v.forced_symbols(["zh", "en", "tr", "es"])


def _values(xs: list[str]) -> str:
    return ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(xs))


def _symbols(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "ord int, piece string")


@query(met_sql(_FORCED, "piece"))
def forced_symbols(spark, sf_dir):
    """The symbols that a vocabulary must hold, and how many documents show each."""
    return met(spark, sf_dir, _FORCED, "piece")


@query(f"with f as (select distinct unnest({words('text')}) as piece from benchmark) select count(*) as forced, 8000 as target, round(count(*) * 100 / 8000, 6) as percent, count(*) < 8000 - 256 as fits from f")
def vocab_capacity(spark, sf_dir):
    """What room a vocabulary of 8,000 has beside the words of the benchmark."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("piece")).distinct()
    return v.capacity(w, 8000)


_PIECES = f"{_WORDS}, ranked as (select word as piece, frequency, row_number() over (order by frequency desc, word) as r from (select word, cast(sum(frequency) as bigint) as frequency from freq group by word))"


def _ranked(spark, sf_dir):
    w = frequencies(spark, sf_dir).groupBy("word").agg(F.sum("frequency").cast("long").alias("frequency"))
    return c.top(w, 2000, "frequency", "word").select(F.col("word").alias("piece"), "frequency")


_USED = "used as (select distinct cast(doc_id * 3 % 1000 as integer) as id from documents)"


@query(
    f"with {_PIECES}, {_USED}, free as (select id, row_number() over (order by id) as k from (select cast(i as integer) as id from range(0, 1500) t(i) where i not in (select id from used))) select piece, id from (select piece, row_number() over (order by frequency desc, piece) as k from ranked where r <= 2000) join free using (k)"
)
def gap_fill(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3 % 1000).cast("int").alias("id")).distinct()
    p = _ranked(spark, sf_dir).withColumn("ord", F.struct((-F.col("frequency")).alias("f"), "piece"))
    return v.fill_gaps(p, used, 1500, "ord").select("piece", "id")


@query(f"with {_PIECES}, {_USED}, free as (select id, row_number() over (order by id desc) as k from (select cast(i as integer) as id from range(0, 1201) t(i) where i not in (select id from used))) select piece, id from (select piece, row_number() over (order by frequency desc, piece) as k from ranked where r <= 100) join free using (k)")
def ids_downward(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3 % 1000).cast("int").alias("id")).distinct()
    p = _ranked(spark, sf_dir).orderBy(F.desc("frequency"), "piece").limit(100).withColumn("ord", F.struct((-F.col("frequency")).alias("f"), "piece"))
    return v.allocate_down(p, used, 1200, "ord").select("piece", "id")


@query(f"with {_PIECES} select ord, piece from (values {_values(_FORCED)}) t(ord, piece) where piece not in (select piece from ranked where r <= 2000)")
def missing_symbols(spark, sf_dir):
    return v.missing(_symbols(spark, _FORCED), _ranked(spark, sf_dir)).select("ord", "piece")


_REQUIRED = [("letter", x) for x in "abcçdefgğhıijklmnoöprsştuüvyz"] + [("mark", x) for x in ".,?!:;'"] + [("word", x) for x in ("the", "de", "la", "und")]


@query(f"with {_PIECES}, need as (select k as kind, p as piece from (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{p.replace(chr(39), chr(39) * 2)}{chr(39)})' for k, p in _REQUIRED)}) t(k, p)) select kind, count(*) as required, count(*) filter (where piece not in (select piece from ranked where r <= 2000)) as missing, count(*) filter (where piece not in (select piece from ranked where r <= 2000)) = 0 as safe from need group by kind")
def safety_check(spark, sf_dir):
    need = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("piece")) for k, p in _REQUIRED))).alias("x")).select("x.*")
    return v.safety(need, _ranked(spark, sf_dir))


_ALLOWED = r"^[▁a-zA-ZçÇğĞıİöÖşŞüÜâÂîÎûÛ0-9.,?!:;''()\[\]\-]+$"


@query(
    f"""with {_PIECES}, voc as (select cast(r + 9200 as integer) as id, piece, cast(-r as double) as score from ranked where r <= 2700) select id, case when id between 10201 and 11999 then lower(piece) else piece end as piece, score from voc
where id <> 11999 and case when contains(piece, '[the]') then false when piece in ('<s>', '</s>', '<unk>', ' ', '▁') then true when regexp_matches(replace(piece, '▁', ''), '^[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+$') then false when id between 10201 and 11999 then true when regexp_matches(piece, '[一-鿿぀-ヿ가-힯]') then false when not regexp_matches(piece, '{_ALLOWED}') then false else true end union all select 11999, '<pad>', 0.0"""
)
def vocab_design(spark, sf_dir):
    from pyspark.sql import Window

    w = frequencies(spark, sf_dir).groupBy("word").agg(F.sum("frequency").cast("long").alias("frequency"))
    top = c.top(w, 2700, "frequency", "word")  # a vocabulary, bounded by its size
    r = F.row_number().over(Window.orderBy(F.desc("frequency"), "word"))
    voc = top.select((r + 9200).cast("int").alias("id"), F.col("word").alias("piece"), (-r).cast("double").alias("score"))
    return v.design(voc, 12000, ("[the]",), strip_punctuation=True)


@query(
    f"""with d as ({SQL['vocab_design']}), need as (select ord, piece from (values {_values(_FORCED)}) t(ord, piece) where piece not in (select piece from d)),
free as (select id, row_number() over (order by id) as k from (select cast(i as integer) as id from range(0, 12000) t(i) where i not in (select id from d))), given as (select piece, row_number() over (order by ord) as k from need)
select id, piece, cast(score as double) as score from d union all select id, piece, cast(0 as double) from given join free using (k)"""
)
def vocab_rebuild(spark, sf_dir):
    """The designed vocabulary with the required symbols put in where ids are free."""
    return v.rebuilt(vocab_design(spark, sf_dir), _symbols(spark, _FORCED), 12000)


@query(f"with {_WORDS}, sym as (select list_filter(string_split('▁' || word, ''), lambda c: c <> '') as s, frequency from freq where lang = 'en'), p as (select unnest(list_zip(s[:-2], s[2:])) as p, frequency from sym where len(s) > 1) select p[1] as a, p[2] as b, cast(sum(frequency) as bigint) as n from p group by all")
def bpe_pairs(spark, sf_dir):
    w = frequencies(spark, sf_dir).where("lang = 'en'")
    return v.pair_counts(w.select(F.filter(F.split(F.concat(F.lit(v.MARK), "word"), ""), lambda x: x != "").alias("symbols"), "frequency"))


@query("select id, text, id < (select cast(floor(count(*) * 0.85) as bigint) from documents) as train from (select row_number() over (order by doc_id) - 1 as id, text from documents)")
def numbered_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.broadcast(d.agg(F.floor(F.count("*") * 0.85).alias("edge")))
    return v.numbered(d, F.col("doc_id"), name="id").crossJoin(n).select((F.col("id") - 1).alias("id"), "text", (F.col("id") - 1 < F.col("edge")).alias("train"))
