"""Queries of Turkish speech: words in full, phonemes, spoken dates, times and amounts, reports and exceptions of stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phonemes as ph
from ..functions import syllables as sy
from ..functions import text as tx
from ..functions import turkish as tr
from ..operators import words as words_op
from ..operators.corpus import spread
from .registry import documents, query, set_apart, squeezed, stripped, table, words
from .turkish import _ANY, _BACK, _CLEAN, _EXC, _IDS, _LIST, _PAUSED, _STRESS, _SYLLABLES, _number, _spoken, _syllables, _vocab


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LETTERS = "map {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in (ph.LETTERS | {"'": "'"}).items()) + "}"
_NAMES = "[" + ", ".join(map(_quoted, ph.VOCABULARY)) + "]"


def _spelled(said: str) -> str:
    """From a table said(w, ...) of words as they stand: clean, syllables, phonemes by syllable (p); markers are one."""
    plain = "regexp_replace(lower(w), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]', '', 'g')"
    stress = _STRESS.replace("word", "k")
    of = f"array_to_string(list_transform(string_split(case when i - 1 = pos then '''' || x else x end, ''), lambda z: coalesce({_LETTERS}[z], '')), '')"
    return f"""k1 as (select *, w like '<%>' as marker, {plain} as k from {said}), k2 as (select *, {_CLEAN.replace('word', 'k')} as c from k1 where marker or k <> ''), k3 as (select *, {_syllables('c')} as s from k2), k4 as (select *, {stress} as pos from k3),
spelled as (select *, case when marker then [w] else list_transform(s, lambda x, i: {of}) end as p from k4)"""


@query(
    f"""{_SYLLABLES.replace('select word, c, ', 'select word, c, c as k, ')}, a as (select word, c, s, cast({_STRESS.replace('lower(word)', 'lower(c)')} as integer) as pos, length(regexp_replace(c, '[^{sy.FRONT}]', '', 'g')) as f, length(regexp_replace(c, '[^{_BACK}]', '', 'g')) as b from syl)
select word, c as clean, array_to_string(s, '-') as syllables, cast(len(s) as integer) as n_syllables, array_to_string(list_transform(s, lambda x, i: case when i - 1 = pos then '''' || x else x end), '-') as stressed, pos as stress_position,
f + b > 0 and not (f > 0 and b > 0) as harmony, case when f + b = 0 then 'Invalid word - no vowels' when f + b = 1 then 'Single vowel - trivially harmonic' when f > 0 and b > 0 then '{sy.MIXED}' when f > 0 then 'All front vowels - harmonic' else 'All back vowels - harmonic' end as harmony_note,
len(s) > 0 and s[-1] in {_LIST(sy.NEUTRAL)} as neutral_suffix, len(s) > 0 and s[-1] in {_LIST(sy.QUESTION)} as question from a"""
)
def word_analysis(spark, sf_dir):
    a = _vocab(spark, sf_dir).select(sy.analyze(F.col("word")).alias("a")).select("a.*")
    return a.withColumns({"syllables": F.array_join("syllables", "-"), "stressed": F.array_join("stressed", "-")})


_BY_WORD = f"said as (select w, count(*) as n from (select unnest({words('lower(text)')}) as w from documents) group by w)"


@query(f"with {_BY_WORD}, {_spelled('said')}, ids as (select n, unnest(list_transform(regexp_extract_all(array_to_string(p, '-'), '(?s){_ANY}'), lambda x: coalesce({_IDS}[x], 1))) as id from spelled) select cast(id as integer) as id, {_NAMES}[id + 1] as phoneme, cast(sum(n) as bigint) as n from ids group by id")
def phoneme_frequency(spark, sf_dir):
    """How often each phoneme occurs in the corpus read as Turkish: each distinct word is converted once."""
    w = documents(spark, sf_dir).select(F.explode(tx.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ids = ph.to_ids(ph.phoneme_string(F.col("word"), False))
    counts = w.select("n", F.explode(ids).alias("id")).groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", F.element_at(F.array(*map(F.lit, ph.VOCABULARY)), F.col("id") + 1).alias("phoneme"), "n")


_ITEMS = f"said as (select item_id, unnest({words(_PAUSED)}) as w, unnest(range(0, len({words(_PAUSED)}))) as i from benchmark)"
_STRINGS = f"with {_ITEMS}, {_spelled('said')}, whole as (select item_id, string_agg(array_to_string(p, '-'), ' ' order by i) as phonemes, list(p order by i) as ps from spelled group by item_id)"


@query(f"{_STRINGS} select item_id, phonemes, cast(len(ps) as integer) as n from whole")
def text_phonemes(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.size(ph.tokens(F.col("text"))).alias("n"), ph.phoneme_string(F.col("text")).alias("phonemes"))
    return b.where("n > 0")


_PAUSE = "case when contains(x, 'PAUSE_SHORT') then 150 when contains(x, 'PAUSE_MED') then 250 when contains(x, 'PAUSE_LONG') then 400 else 0 end"


@query(f"{_STRINGS} select item_id, cast(list_sum(list_transform(flatten(ps), lambda x: case when x[1] = '<' then {_PAUSE} when regexp_matches(x, '[aeıioöuü]') then case when x[1] = '''' then 96 else 80 end else 60 end)) as bigint) as ms, cast(len(ps) as bigint) as n_tokens from whole")
def phoneme_durations(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").withColumn("t", F.explode(ph.tokens(F.col("text"))))
    total = F.aggregate(ph.durations(F.col("t.phonemes")), F.lit(0), lambda s, x: s + x)
    return t.groupBy("item_id").agg(F.sum(total).alias("ms"), F.count("*").alias("n_tokens"))


_ID_LISTS = f"{_STRINGS}, ids as (select item_id, list_transform(regexp_extract_all(phonemes, '(?s){_ANY}'), lambda x: coalesce({_IDS}[x], 1)) as ids from whole)"


@query(f"{_ID_LISTS}, flat as (select unnest(ids) as id from ids) select (select count(*) from benchmark) as total_texts, count(*) as total_phonemes, count(distinct id) as unique_phonemes, {len(ph.VOCABULARY)} as vocab_size, round(count(distinct id) / {len(ph.VOCABULARY)}.0, 6) as coverage, count(*) filter (where id = 1) as unknown, round(count(*) filter (where id = 1) / greatest(count(*), 1), 6) as unknown_ratio from flat")
def phoneme_coverage(spark, sf_dir):
    c = words_op.phoneme_coverage(table(spark, sf_dir, "benchmark"), "text", False)
    return c.withColumns({n: F.round(n, 6) for n in ("coverage", "unknown_ratio")})


@query(f"{_ID_LISTS}, f as (select item_id, list_concat([2], ids, [3]) as x from ids), m as (select max(len(x)) as n from f) select item_id, array_to_string(list_concat(x, list_transform(range(0, n - len(x)), lambda i: 0)), ' ') as ids, array_to_string(list_concat(list_transform(x, lambda i: case when i = 0 then 0 else 1 end), list_transform(range(0, n - len(x)), lambda i: 0)), '') as mask from f, m")
def batch_encode(spark, sf_dir):
    """Ids with their frame, padded to the longest, and the mask."""
    b = table(spark, sf_dir, "benchmark").where(F.size(ph.tokens(F.col("text"))) > 0)
    out = words_op.batch_encode(b, "text", ("item_id",), True, False)
    return out.select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


@query(f"with w as (select item_id, unnest({words('text')}) as word, unnest(range(0, len({words('text')}))) as i from benchmark), syl as (select item_id, i, word, {_syllables(_CLEAN)} as s from w), h as (select *, length(regexp_replace(lower(word), '[^{sy.FRONT}]', '', 'g')) > 0 as f, length(regexp_replace(lower(word), '[^{_BACK}]', '', 'g')) > 0 as b from syl where len(s) > 0) select item_id, string_agg(word || ' -> ' || array_to_string(s, '-') || ' | Harmony: ' || case when f <> b then '✅' else '❌' end, chr(10) order by i) as report, string_agg(array_to_string(s, ', '), ', ' order by i) as flat from h group by item_id")
def syllable_report(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", sy.report(F.col("text")).alias("report"), sy.flat(F.col("text")).alias("flat"))
    return b.where("report <> ''")


@query(
    f"""{_SYLLABLES}, n as (select count(*) as words, count(*) filter (where {_EXC}[replace(lower(word), '''', '')] is not null) as e, count(*) filter (where len(s) > 0 and s[-1] in {_LIST(sy.NEUTRAL)}) as t, count(distinct s[1]) filter (where len(s) > 0) as b from syl)
select * from (values {', '.join(f'({_quoted(k)}, {_quoted(str(v))})' for k, v in sy.statistics().items())}) t(name, value) union all select unnest(['words', 'exceptions_met', 'neutral_suffixes_met', 'first_syllables']), unnest([words::varchar, e::varchar, t::varchar, b::varchar]) from n"""
)
def syllabifier_statistics(spark, sf_dir):
    """What the rules are made of, and what of it the vocabulary meets."""
    s = _vocab(spark, sf_dir).withColumn("s", sy.syllables(F.col("word")))
    met = s.agg(F.count("*").alias("words"), F.count_if(sy.exception_word(F.col("word")).isin(list(sy.EXCEPTIONS))).alias("exceptions_met"), F.count_if(sy.has_neutral_suffix(F.col("s"))).alias("neutral_suffixes_met"), F.count_distinct(F.when(F.size("s") > 0, F.get("s", F.lit(0)))).alias("first_syllables"))
    rows = met.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in met.columns])).alias("r")).select("r.*")
    return spark.createDataFrame([(k, str(v)) for k, v in sy.statistics().items()], "name string, value string").unionByName(rows)


@query(
    f"""{_SYLLABLES}, given as (select word, length(word) % 4 as position from vocab), ok as (select replace(lower(g.word), '''', '') as word, max(g.position) as position from given g join (select word, {_syllables(_CLEAN.replace('word', "replace(lower(word), chr(39), '')"))} as e from vocab) x using (word) where g.position < len(x.e) group by 1),
every as (select * from ok union all select unnest(map_keys({_EXC})) as word, unnest(map_values({_EXC})) as position) select word, cast(coalesce(max(position) filter (where word in (select word from ok)), max(position)) as integer) as position from (select distinct e.word, coalesce(o.position, e.position) as position from every e left join ok o using (word)) where word <> 'ankara' group by word"""
)
def stress_exceptions(spark, sf_dir):
    """Exceptions imported from the whole vocabulary where they are valid, merged with the known ones, one word removed."""
    given = _vocab(spark, sf_dir).withColumn("position", F.length("word") % 4)
    old = spark.createDataFrame(list(sy.EXCEPTIONS.items()), "word string, position int")
    return words_op.merged_exceptions(old, words_op.valid_exceptions(given), spark.createDataFrame([("Ankara",)], "word string"))


_RULES = "case when len(s) = 0 then null when len(s) = 1 then 0 when s[-1] in {q} then len(s) - 2 when p < len(s) then p when s[-1] in {n} then len(s) - 2 else len(s) - 1 end".format(q=_LIST(sy.QUESTION), n=_LIST(sy.NEUTRAL))


@query(f"{_SYLLABLES}, p as (select word, s, case when length(word) % 5 = 0 then 0 end as p from syl) select word, cast({_RULES} as integer) as position from p")
def stress_by_table(spark, sf_dir):
    """Stress under exceptions that are a table, the first syllable of every word whose length is a multiple of five."""
    v = _vocab(spark, sf_dir)
    e = v.where(F.length("word") % 5 == 0).select(sy.exception_word(F.trim("word")).alias("word"), F.lit(0).alias("position")).distinct()
    lengths = v.where(F.length("word") % 5 != 0).select(sy.exception_word(F.trim("word")).alias("word")).distinct()
    own = words_op.stressed_by(v.where(F.length("word") % 5 == 0), e)
    return own.unionByName(words_op.stressed_by(v.where(F.length("word") % 5 != 0), e.join(lengths, "word", "left_anti")))


# The rules for dates, times and amounts, over every order, event and part.
_MONTHS = "[" + ", ".join(map(_quoted, tr.MONTHS)) + "]"
_D, _M, _Y = "cast(day(o_orderdate) as bigint)", "cast(month(o_orderdate) as bigint)", "cast(year(o_orderdate) as bigint)"
_DATES = "select o_orderkey, '<' || X || ' ' || " + _MONTHS + f"[{_M}] || ' ' || Z || '>' as out from orders"


def _dates(spark, sf_dir, rule, sign: str):
    text = F.concat(F.lit("<"), F.date_format("o_orderdate", f"dd{sign}MM{sign}yyyy"), F.lit(">"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", rule(text).alias("out"))


@query(_DATES.replace("X", _number(_D)).replace("Z", _number(_Y)))
def dates_tr(spark, sf_dir):
    return _dates(spark, sf_dir, tr.say_dates, ".")


@query(_DATES.replace("X", _spoken(_D)).replace("Z", _spoken(_Y)))
def spoken_dates(spark, sf_dir):
    return _dates(spark, sf_dir, ph.say_dates, "/")


_H, _MIN = "cast(hour(ts) as bigint)", "cast(minute(ts) as bigint)"


@query(f"select event_id, 'at ' || {_number(_H)} || {_number(_MIN)} || ' or' as wordy, 'at saat ' || {_spoken(_H)} || ' ' || {_spoken(_MIN)} || ' or' as spoken from events")
def times_tr(spark, sf_dir):
    text = F.concat(F.lit("at "), F.date_format("ts", "HH:mm"), F.lit(" or"))
    return spread(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", tr.say_times(text).alias("wordy"), ph.say_times(text).alias("spoken"))


_LIRA, _KURUS = "cast(floor(a) as bigint)", "cast(round_even((a - floor(a)) * 100, 0) as bigint)"


@query(f"select p_partkey, {_spoken(_LIRA)} || ' lira' || case when {_KURUS} > 0 then ' ' || {_spoken(_KURUS)} || ' kuruş' else '' end || ', yüzde ' || case when p_size % 2 = 0 then {_spoken('cast(p_size as bigint)')} else p_size || ' nokta 5' end as out from (select *, cast(printf('%.2f', p_retailprice) as double) as a from part)")
def amounts_tr(spark, sf_dir):
    said = F.concat(F.format_string("%.2f ₺, ", "p_retailprice"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "%").otherwise(",5 %"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")).select("p_partkey", ph.say_percent(ph.say_currency(said)).alias("out"))


@query(f"select o_orderkey, 'x ' || o_orderkey || '000 y' as thousands, {_number('cast(o_orderkey as bigint)')} || ' a' || {_number('cast(o_custkey as bigint)')} as numbers, 'b ' || {_number('cast(o_custkey as bigint)')} as glued from orders")
def digits_tr(spark, sf_dir):
    """Thousands joined, numbers said, digits next to letters split off."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    numbers = F.concat(tr.say_numbers(F.concat(k, F.lit(" "))), F.lit("a"), tr.say_numbers(c))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", tr.join_thousands(F.concat(F.lit("x "), k, F.lit(".000 y"))).alias("thousands"), numbers.alias("numbers"), tr.say_glued(F.concat(F.lit("b"), c)).alias("glued"))


_SHORT = "[" + ", ".join(f"{{'s': {_quoted(k)}, 'l': {_quoted(v)}}}" for k, v in tr.ABBREVIATIONS.items()) + "]"


@query(f"select doc_id, source || ' ' || {_SHORT}[doc_id % {len(tr.ABBREVIATIONS)} + 1].l || ' ' || lang as out from documents")
def abbreviations_tr(spark, sf_dir):
    """Every short form, in turn, in capitals where that is no other letter."""
    short = F.element_at(F.array(*map(F.lit, tr.ABBREVIATIONS)), (F.col("doc_id") % len(tr.ABBREVIATIONS) + 1).cast("int"))
    said = F.concat_ws(" ", "source", F.when(short.rlike("^[a-hj-z.]+$"), F.upper(short)).otherwise(short), "lang")
    return documents(spark, sf_dir).select("doc_id", tr.expand_abbreviations(said).alias("out"))


_FIXED = "text"
for _a, _b in ph.CONTRACTIONS.items():
    _FIXED = f"replace({_FIXED}, {_quoted(_a)}, {_quoted(_b)})"


@query(f"select doc_id, {_FIXED.replace('text', '(text || chr(32) || CON)').replace('CON', _quoted(' '.join(ph.CONTRACTIONS)))} as out from documents")
def contractions_tr(spark, sf_dir):
    text = F.concat_ws(" ", "text", F.lit(" ".join(ph.CONTRACTIONS)))
    return documents(spark, sf_dir).select("doc_id", ph.contractions(text).alias("out"))


@query("select page_id, '<URL> and <EMAIL>, ' || page_id as out from pages")
def addresses_tr(spark, sf_dir):
    text = F.concat(F.col("url"), F.lit(" and u"), F.col("page_id").cast("string"), F.lit("@mail-x.example, "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", ph.mark_addresses(text).alias("out"))


_KEPT = "[^" + "".join("\\" + c if c in "[]-.?()" else "''" if c == "'" else c for c in tr.KEEPS) + "]"
_LIKE = "text"
for _a, _b in tr.LOOK_ALIKES.items():
    _LIKE = f"replace({_LIKE}, {_quoted(_a)}, {_quoted(_b)})" if _a not in "\n\t" else f"replace({_LIKE}, chr({ord(_a)}), ' ')"
_CHARS = "string_split(x, '')"
#: Repeats of a sign go, but for points, as nothing of the kind looks back in this SQL.
_SINGLE = f"array_to_string(list_transform(list_zip({_CHARS}, list_concat([''], ({_CHARS})[:-2])), lambda z: case when z[1] = z[2] and not regexp_matches(z[1], '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s.]') then '' else z[1] end), '')"
_DOTS = f"regexp_replace({squeezed('x')}, '(?:\\.\\s*){{2,}}', ' ^ ', 'g')"


@query(
    f"with a as (select doc_id, lower(translate({_LIKE}, 'IİƏÑŊÝ', 'ıiəñŋý')) as x from documents), b as (select doc_id, {_SINGLE} as x from a), c as (select doc_id, {_DOTS} as x from b), d as (select doc_id, replace(replace({set_apart('x')}, '^', '...'), '\"', '''''') as x from c) select doc_id, {stripped(f"regexp_replace({squeezed('x')}, '{_KEPT}', '', 'g')")} as out from d"
)
def norm_tr(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tr.normalize(F.col("text")).alias("out"))
