"""Queries of tables, files and projects, each through a folder of its own in the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.naming import is_pdf
from ..operators import catalog as cat
from ..operators import tables as tb
from ..session import delete, own_folder, settled
from ..sources import files as fl
from ..sources import projects as pj
from .registry import query, table, words


def _folder(spark) -> str:
    return own_folder(spark, "workspace")


@query(
    """with n as (select count(*) as n from documents), t as (select count(*) as t from documents where length(text) >= 500) select 'listed' as step, 5 as n union all select 'written', n from n union all select 'again', 2 * n from n
 union all select 'refused', 2 * n from n union all select 'flagged', 2 * t from t union all select 'reset', 0 union all select 'emptied', 0 union all select 'missing', 0"""
)
def table_life(spark, sf_dir):
    """Tables made if absent, written twice, a write that fails, flags set and set back, a table emptied, the database dropped."""
    name, steps = f"corpus_{uuid.uuid4().hex}", []
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("chunk_no"), "lang", "text", (F.length("text") >= 500).alias("is_normalized"))
    count = lambda: spark.table(f"{name}.chunks").count()
    try:
        for _ in range(2):
            tb.create_corpus(spark, name, _folder(spark))
        steps.append(("listed", spark.sql(f"SHOW TABLES IN {name}").count()))
        for step, frame in (("written", rows), ("again", rows), ("refused", rows.drop("lang"))):
            tb.write(frame, f"{name}.chunks")
            steps.append((step, count()))
        flagged = spark.table(f"{name}.chunks")
        steps += [("flagged", flagged.where("is_normalized").count()), ("reset", tb.reset_flags(flagged, *tb.FLAGS["chunks"]).where("is_normalized").count())]
        tb.truncate(spark, f"{name}.chunks")
        steps += [("emptied", count()), ("missing", int(tb.truncate(spark, f"{name}.nothing")))]
    finally:
        tb.drop_corpus(spark, name)
    return spark.createDataFrame(steps, "step string, n long")


@query(
    """with l as (select list(lang order by lang) as l from (select distinct lang from documents)), k as (select l, unnest(range(1, len(l) + 1)) as k from l),
s as (select 0 as turn, k, l[k] as said, true as done, l[1:k] as p from k union all select 1, k, ' ' || l[k] || ' ', false, l from k union all select 2, k, l[k] || ' to ' || l[k] || '2', true, list_concat(list_transform(l[1:k], lambda x: x || '2'), l[k + 1:]) from k
 union all select 3, k, 'not ' || l[k], false, list_transform(l, lambda x: x || '2') from k union all select 4, k, l[k] || '2', true, case when k = len(l) then ['myproject'] else list_transform(l[k + 1:], lambda x: x || '2') end from k)
select cast(row_number() over (order by turn, k) - 1 as integer) as n, said, done, array_to_string(list_sort(p), ',') as projects from s"""
)
def project_life(spark, sf_dir):
    """A project for each language: made, made again, renamed, deleted without consent, deleted; and what is refused of that."""
    root = _folder(spark)
    names = sorted(r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().collect())
    steps = [(x, lambda x=x: pj.create(spark, root, x)) for x in names] + [(f" {x} ", lambda x=x: pj.create(spark, root, f" {x} ")) for x in names]
    steps += [(f"{x} to {x}2", lambda x=x: pj.rename(spark, root, x, f"{x}2")) for x in names]
    steps += [(f"not {x}", lambda x=x: pj.delete(spark, root, f"{x}2", x)) for x in names] + [(f"{x}2", lambda x=x: pj.delete(spark, root, f"{x}2", f"{x}2")) for x in names]
    try:
        rows = [(n, said, bool(run()), ",".join(pj.listed(spark, root))) for n, (said, run) in enumerate(steps)]
    finally:
        delete(spark, root)
    return spark.createDataFrame(rows, "n int, said string, done boolean, projects string")


@query("select source as project, lang as dataset, lang || '_train.jsonl' as train, lang || '_val.jsonl' as val from (select source, min(lang) as lang from documents group by source)")
def project_discovery(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), "lang").distinct()
    names = F.array(F.concat("lang", F.lit("_train.jsonl")), F.concat("lang", F.lit("_val.jsonl")), F.lit("notes.txt"))
    return cat.discovered(d.select("project", F.explode(names).alias("name")), "project", "name")


@query("select doc_id, coalesce(case when doc_id % 3 > 0 then 4000 * (doc_id % 3) end, 12000) <> 8000 as changed, 8000 as size, case when doc_id % 2 = 0 then case when doc_id % 4 = 0 then 'lowercase' else 'titlecase' end else 'uppercase' end as case_format from documents")
def config_sync(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 > 0, 4000 * (k % 3)).cast("int").alias("size"), cat.case_of(k % 2 == 0, F.when(k % 4 != 0, "titlecase")).alias("case_format"))
    return cat.synced(rows, "size", F.lit(8000))


@query("select lang, cast(sum(length(text) + 1) as bigint) as characters from documents group by lang")
def text_files(spark, sf_dir):
    """Texts written as files, a folder for each language, and read as whole files."""
    path = _folder(spark)
    table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    found = fl.read_texts(spark, f"{path}/*/*.txt")
    return found.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).agg(F.sum(F.length("text")).cast("long").alias("characters"))


_LINE = "trim(translate(text, '|' || chr(10) || chr(13), '   '))"


@query(f"select lang, source as dataset, cast(doc_id as varchar) as filename, 'spk' || (doc_id % 7) as speaker, {_LINE} as text from documents")
def metadata_files(spark, sf_dir):
    """Lines appended to a file of metadata in two parts, and read."""
    path = _folder(spark)
    for even in (True, False):
        d = table(spark, sf_dir, "documents").where((F.col("doc_id") % 2 == 0) == even)
        fl.write_metadata(d.select("lang", F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("filename"), F.concat(F.lit("spk"), (F.col("doc_id") % 7).cast("string")).alias("speaker"), "text"), path)
    return fl.read_metadata(spark, path)


@query("select cast(doc_id as varchar) as id, text, lang as language, cast(n_chars as integer) as text_len from documents")
def manifest_files(spark, sf_dir):
    """A manifest written as JSON lines and read."""
    path = _folder(spark)
    fl.write_manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("language"), F.col("n_chars").cast("int").alias("text_len")), path)
    return fl.read_manifest(spark, path).select("id", "text", "language", "text_len")


@query("select source as piece, cast(-row_number() over (order by source) as double) as score from (select distinct source from documents)")
def vocabulary_files(spark, sf_dir):
    """A vocabulary written by id, a line for each piece, and read."""
    from ..operators.vocab import numbered

    path = _folder(spark)
    pieces = numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("piece")).distinct(), F.col("piece"), name="id")
    fl.write_vocabulary(pieces.withColumn("score", (-F.col("id")).cast("double")), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("piece"), parts[1].cast("double").alias("score"))


@query("select c as piece, cast(row_number() over (order by c) - 1 as integer) as id from (select distinct unnest(string_split(text, '')) as c from benchmark) where c <> ''")
def vocabulary_json(spark, sf_dir):
    """The characters of the benchmark as a vocabulary in JSON, written and read."""
    path = _folder(spark)
    each = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").distinct()
    fl.write_map(spark, path, {c: i for i, c in enumerate(sorted(r.c for r in each.collect()))})  # an alphabet
    try:
        return settled(fl.read_map(spark, path))
    finally:
        delete(spark, path)


@query("select source || '.' as key, case when source < 'src2' then 'b=c:' else '' end || lang as value from (select source, min(lang) as lang from documents group by source)")
def abbreviation_files(spark, sf_dir):
    """A line for each source, of either kind, among comments, blank lines and lines that say nothing; read back."""
    path = _folder(spark)
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("lang"))
    line = F.when(F.col("source") < "src2", F.concat("source", F.lit(". = b=c:"), "lang")).otherwise(F.concat(F.lit("  "), "source", F.lit(".:"), "lang"))
    noise = [F.concat(F.lit("# "), "source"), F.lit(""), F.concat(F.lit("="), "lang"), F.concat("source", F.lit("=")), F.col("source")]
    s.select(F.explode(F.array(line, *noise)).alias("value")).write.text(path)
    try:
        return spark.createDataFrame(sorted(fl.read_abbreviations(spark, path).items()), "key string, value string")
    finally:
        delete(spark, path)


@query(
    f"""with w as (select distinct unnest({words('text')}) as word from benchmark), e as (select word, time, row_number() over (order by md5('7:' || time || ':' || word), word, time) - 1 as place from w, (select unnest([1, 2]) as time))
select place // 50 as no, string_agg(word, ' ' order by place) as line from e group by place // 50"""
)
def lexicon_line(spark, sf_dir):
    """Every word of the benchmark twice, shuffled by a seed, fifty to a line."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word"))
    return fl.lexicon_lines(w, "word", 2, 7, 50)


@query("select cast(count(*) as integer) as size, max(source) as name, count(distinct lang) > 1 as merged from documents")
def config_files(spark, sf_dir):
    """What is known of the documents as a file of settings, written and read."""
    path = _folder(spark)
    r = table(spark, sf_dir, "documents").agg(F.count("*").alias("size"), F.max("source").alias("name"), (F.count_distinct("lang") > 1).alias("merged")).first()
    fl.write_config(spark, path, size=r["size"], name=r["name"], merged=r["merged"])
    try:
        return settled(spark.read.schema("size int, name string, merged boolean").json(path))
    finally:
        delete(spark, path)


@query("select doc_id, doc_id % 3 = 0 as pdf from documents")
def pdf_check(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-").otherwise("PDF")
    return table(spark, sf_dir, "documents").select("doc_id", is_pdf(F.concat(head, F.col("text")).cast("binary")).alias("pdf"))


@query("select lang, count(*) as n from documents group by lang")
def dataset_fallback(spark, sf_dir):
    """No folder of a language, no converted branch: the dataset as a whole."""
    return fl.read_dataset(spark, sf_dir, "documents", "en").groupBy("lang").agg(F.count("*").alias("n"))


@query("select vec_id, case when vec_id % 5 = 0 then null else cast(len(embedding) as integer) end as n, case when vec_id % 5 = 0 then null else round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) end as total from embeddings")
def sample_arrays(spark, sf_dir):
    """Arrays kept as JSON; what is cut off can't be read and is null."""
    said = F.to_json("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.concat(F.substring(said, 1, 20), F.lit("x"))).otherwise(said).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return fl.read_samples(rows, "x", "array<double>").select("vec_id", F.when(F.col("x").isNotNull(), F.size("x")).alias("n"), F.round(total, 4).alias("total"))
