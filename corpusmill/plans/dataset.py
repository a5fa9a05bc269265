"""Queries of the dataset operators: metadata, splits, segments, sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import naming as nm
from ..operators import dataset as ds
from .registry import query, stripped, table, words


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("select doc_id, case when doc_id % 3 = 0 then lang when doc_id % 3 = 1 then source else '' end as out from documents")
def coalesce_text(spark, sf_dir):
    k = F.col("doc_id") % 3
    return _docs(spark, sf_dir).select("doc_id", ds.first_text(F.when(k == 0, F.col("lang")).otherwise(""), F.when(k == 1, F.col("source")), F.lit("")).alias("out"))


_LINE = "lang || '|' || source || '|audio_' || lpad(cast(doc_id as varchar), 6, '0') || '.wav|' || 'spk' || (doc_id % 7) || '|' || replace(replace(text, '|', ' '), chr(10), ' ')"


def _lines(spark, sf_dir):
    flat = F.translate("text", "|\n", "  ")
    return _docs(spark, sf_dir).select("doc_id", ds.metadata_line(F.col("lang"), F.col("source"), ds.clip_name(F.col("doc_id")), F.concat(F.lit("spk"), (F.col("doc_id") % 7).cast("string")), flat).alias("line"))


@query(f"select doc_id, {_LINE} as line from documents")
def metadata_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"select doc_id, lang, source as dataset, 'audio_' || lpad(cast(doc_id as varchar), 6, '0') || '.wav' as filename, 'spk' || (doc_id % 7) as speaker, {stripped("replace(replace(text, '|', ' '), chr(10), ' ')")} as text from documents")
def metadata_scan(spark, sf_dir):
    from ..functions.text import strip

    p = _lines(spark, sf_dir).select("doc_id", ds.read_line(F.col("line")).alias("p")).select("doc_id", "p.*").dropna(subset=["filename", "text"])
    return p.withColumn("text", strip(F.col("text")))


@query("select doc_id, 'audio_' || lpad(cast(row_number() over (order by doc_id) - 1 as varchar), 6, '0') || '.wav' as name from documents")
def clip_names(spark, sf_dir):
    from ..operators.vocab import numbered

    return numbered(_docs(spark, sf_dir).select("doc_id"), F.col("doc_id")).select("doc_id", ds.clip_name(F.col("place") - 1).alias("name"))


@query("select cast(max(doc_id) + 1 as integer) as next from documents")
def next_clip(spark, sf_dir):
    return ds.next_number(_docs(spark, sf_dir).select(ds.clip_name(F.col("doc_id")).alias("name")), "name")


@query("select doc_id, case when row_number() over (order by doc_id) - 1 < floor((select count(*) from documents) * 0.85) then 'train' else 'val' end as split from documents")
def split_train_val(spark, sf_dir):
    return ds.split_position(_docs(spark, sf_dir).select("doc_id"), "doc_id", 15)


@query("select max(n_chars) as text_len, max(greatest(n_chars * 2, 8)) as code_len, greatest(600, max(n_chars) + 100) as max_text, greatest(1500, max(n_chars * 2) + 200) as max_code from documents")
def manifest_maxlen(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t, code = F.max("n_chars"), F.max(F.greatest(F.col("n_chars") * 2, F.lit(8)))
    return d.agg(t.alias("text_len"), code.alias("code_len"), F.greatest(F.lit(600), t + 100).alias("max_text"), F.greatest(F.lit(1500), F.max(F.col("n_chars") * 2) + 200).alias("max_code"))


@query("select doc_id, greatest(0, doc_id - 50) as start_ms, least(900, doc_id + n_chars % 2000 + 50) as end_ms from documents where least(900, doc_id + n_chars % 2000 + 50) - greatest(0, doc_id - 50) >= 300")
def segment_filter(spark, sf_dir):
    start, end = ds.pad_segments(F.col("doc_id"), F.col("doc_id") + F.col("n_chars") % 2000, F.lit(900))
    return _docs(spark, sf_dir).select("doc_id", start.alias("start_ms"), end.alias("end_ms")).where("end_ms - start_ms >= 300")


@query("select conv_id, turn, role, length(text) as n from conversations where length(text) >= 2 and not (length(text) * 60 < 2000) and trim(text) <> ''")
def clip_filter(spark, sf_dir):
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").where((n >= 2) & (n * 60 >= 2000) & (F.trim("text") != "")).select("conv_id", "turn", "role", n.alias("n"))


_SEG = "seg as (select conv_id, turn, row_number() over w as k, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) * 0.01 as s, sum(length(text)) over w * 0.01 as e from conversations window w as (partition by conv_id order by turn))"


@query(
    f"""with recursive {_SEG}, walk as (select conv_id, k, s as start, e as stop, 0 as no from seg where k = 1 union all
select g.conv_id, g.k, case when g.e - w.start <= 12.0 then w.start else g.s end, g.e, case when g.e - w.start <= 12.0 then w.no else w.no + 1 end from walk w join seg g on g.conv_id = w.conv_id and g.k = w.k + 1)
select conv_id, cast(no as integer) as segment, round(cast(min(start) as double), 4) as start, round(cast(max(stop) as double), 4) as stop, count(*) as n from walk group by conv_id, no"""
)
def segment_greedy(spark, sf_dir):
    """Turns as segments one after another, 10 ms a character, packed up to 12 seconds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = c.withColumn("end", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n"))
    seg = F.array_sort(F.collect_list(F.struct("turn", "start", "end")))
    g = c.groupBy("conv_id").agg(seg.alias("s"))
    parts = F.transform("s", lambda x: F.struct((x["start"] * F.expr("0.01D")).alias("start"), (x["end"] * F.expr("0.01D")).alias("end"), F.lit("x").alias("text")))
    packed = g.select("conv_id", F.posexplode(ds.pack_segments(parts, F.lit(12.0 + 1e-9))).alias("segment", "p"))
    return packed.select("conv_id", "segment", F.round("p.start", 4).alias("start"), F.round("p.end", 4).alias("stop"), F.size(F.split("p.text", " ")).cast("long").alias("n"))


@query("select doc_id, i as start, least(i + 700, n_chars) as stop from (select doc_id, n_chars, unnest(range(0, n_chars, 700)) as i from documents where n_chars > 0)")
def split_fixed(spark, sf_dir):
    p = _docs(spark, sf_dir).select("doc_id", F.explode(ds.split_fixed(F.col("n_chars"), 700)).alias("p"))
    return p.select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("stop"))


@query("select conv_id, role, count(*) as n_turns, string_agg(text, ' ' order by turn) as text from conversations group by conv_id, role")
def speaker_concat(spark, sf_dir):
    return ds.concat_turns(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text")


@query("select conv_id, string_agg(distinct role, ',' order by role) as speakers from conversations group by conv_id")
def distinct_speakers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers"))


@query("select conv_id, turn, case when lead(turn) over (partition by conv_id order by turn) is not null then 200 else 0 end as gap_ms from conversations")
def silence_gaps(spark, sf_dir):
    return ds.gaps_between(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 200)


_LENGTHS = f"list_transform({words('text')}, lambda w: cast(length(w) as integer))"


@query(f"select item_id, array_to_string(case when x[1] <> 3 then list_concat([3], x) else x end, ' ') as prepended, array_to_string(list_transform(x, lambda i: least(greatest(i, 0), 5)), ' ') as clamped, array_to_string(list_concat([8192], x), ' ') as input, array_to_string(list_concat(x, [8193]), ' ') as target, array_to_string(list_transform(x, lambda v, i: case when i <= 4 then v else 8193 end), ' ') as stopped from (select item_id, {_LENGTHS} as x from benchmark)")
def id_sequences(spark, sf_dir):
    from ..functions.text import words as cut

    x = table(spark, sf_dir, "benchmark").select("item_id", F.transform(cut(F.col("text")), F.length).alias("x"))
    said = lambda a: F.array_join(a.cast("array<string>"), " ")
    start, stop = ds.shifted(F.col("x"), 8192, 8193)
    return x.select("item_id", said(ds.with_language(F.col("x"), F.lit(3))).alias("prepended"), said(ds.clamp(F.col("x"), 5)).alias("clamped"), said(start).alias("input"), said(stop).alias("target"), said(ds.stop_after(F.col("x"), F.lit(4), 8193)).alias("stopped"))


@query("select doc_id, cast(floor(doc_id / 1000 * 100) as integer) as percent, cast(trunc(n_chars * 1.72) as integer) as target from documents")
def progress(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", nm.percent(F.col("doc_id"), F.lit(1000)).alias("percent"), (F.col("n_chars") * F.expr("1.72D")).cast("int").alias("target"))


_TITLE = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(translate(translate({}, 'çÇğĞıIİöÖşŞüÜ', 'cCgGiIIoOsSuU'), '-', ' '), '[!\"#$%&''()*+,./:;<=>?@\\[\\\\\\]^`{{|}}~]', '', 'g'), '\\s+'), lambda w: w <> ''), lambda w: replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:])), '_')"


@query(f"select doc_id, source || '-' || {_TITLE.format('left(text, 20)')} || '-' || {_TITLE.format('right(text, 30)')} as document, 'Audiobook-' || {_TITLE.format('source')} || '-' || {_TITLE.format('lang')} || '-Genre-' || {_TITLE.format('left(text, 20)')} || '-' || {_TITLE.format('right(text, 30)')} as audiobook from documents where text <> '' and source <> '' and lang <> '' union all select doc_id, '{nm.FILL_DOCUMENT}', '{nm.FILL_AUDIOBOOK}' from documents where text = ''")
def name_standard(spark, sf_dir):
    d = _docs(spark, sf_dir)
    author, title = F.substring("text", 1, 20), F.expr("right(text, 30)")
    return d.select("doc_id", nm.document_name(F.col("source"), author, title).alias("document"), nm.audiobook_name(F.col("source"), F.col("lang"), F.lit("Genre"), author, title).alias("audiobook"))


@query("select doc_id, case lang when 'en' then 4 when 'es' then 6 when 'de' then 7 else 0 end as id, case lang when 'en' then 'English' when 'de' then 'German' else lang end as name from documents")
def language_lookup(spark, sf_dir):
    codes = ["zh", "en", "tr", "es", "de"]
    return _docs(spark, sf_dir).select("doc_id", nm.language_id(F.col("lang"), codes).alias("id"), nm.translated(F.col("lang"), {"en": "English", "de": "German"}).alias("name"))


@query("select source, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes, round(sum(strlen(text)) / 1048576.0, 2) as mb from documents group by source")
def project_sizes(spark, sf_dir):
    size = F.sum(F.octet_length("text")).cast("long")
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"), size.alias("bytes"), F.round(size / F.expr("1048576.0D"), 2).alias("mb"))


@query("select distinct lang, source from documents")
def dataset_listing(spark, sf_dir):
    return _docs(spark, sf_dir).select("lang", "source").distinct()


@query("select c.conv_id, c.turn, d.doc_id from conversations c join documents d on d.doc_id = c.conv_id and d.n_chars > 100")
def fk_lookup(spark, sf_dir):
    d = _docs(spark, sf_dir).where("n_chars > 100").select("doc_id")
    return table(spark, sf_dir, "conversations").join(d, F.col("conv_id") == F.col("doc_id")).select("conv_id", "turn", "doc_id")


@query("select doc_id, replace(replace('module._orig_mod.' || source || '.weight', 'module.', ''), '_orig_mod.', '') as key, case when source like '%1' then source else '0_0_' || source end as mute from documents")
def key_rename(spark, sf_dir):
    s = F.col("source")
    return _docs(spark, sf_dir).select("doc_id", nm.renamed_key(F.concat(F.lit("module._orig_mod."), s, F.lit(".weight"))).alias("key"), F.when(s.endswith("1"), s).otherwise(F.concat(F.lit("0_0_"), s)).alias("mute"))


@query("select page_id, case when url like '%1' then 'pdf' when url like '%2' then 'txt' else '' end as kind, replace(regexp_replace(url, '^https:/', ''), chr(92), '/') as path from pages")
def upload_route(spark, sf_dir):
    name = F.concat("url", F.when(F.col("url").endswith("1"), ".PDF").when(F.col("url").endswith("2"), ".txt").otherwise(".doc"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(nm.route(name), F.lit("")).alias("kind"), nm.relative(F.col("url"), "https:/").alias("path"))


@query(f"with w as (select conv_id, turn, list_transform({words('text')}, lambda x: cast(length(x) as double)) as w from conversations), g as (select conv_id, flatten(list(list_concat(w, [0.0, 0.0]) order by turn)) as w from w group by conv_id) select conv_id, cast(len(w) as integer) as n, list_sum(list_transform(w, lambda x, i: x * i)) as sum from g")
def speaker_waves(spark, sf_dir):
    """The words of turns as samples, each turn followed by a gap, the last one too."""
    from ..functions.text import words as cut

    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(cut(F.col("text")), lambda x: F.length(x).cast("double")).alias("w"))
    g = ds.concat_waves(w, ["conv_id"], "turn", "w", 2)
    return g.select("conv_id", F.size("w").alias("n"), F.aggregate(F.transform("w", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).alias("sum"))
