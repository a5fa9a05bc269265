"""Queries of the Turkish rules, over the words and numbers of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import phonemes as ph
from ..functions import syllables as sy
from ..functions import text as tx
from ..functions import turkish as tr
from ..operators import corpus as c
from ..operators import words as words_op
from .registry import SQL, documents, met, met_sql, query, table, words

_DROPPED = "".join(f"\\x{{{i:02x}}}" for i in range(256) if chr(i) not in sy.VOWELS + sy.CONSONANTS)
_CLEAN = f"regexp_replace(lower(word), '[{_DROPPED}]', '', 'g')"
_V, _N = f"[{sy.VOWELS}]", f"[^{sy.VOWELS}]"
_ON = "|".join(sorted(sy.ONSETS, key=lambda x: -len(x)))
_VOCAB = f"vocab as (select distinct unnest({words('text')}) as word from documents), cleaned as (select word, {_CLEAN} as c from vocab)"


def _syllables(w: str) -> str:
    """Syllables of a clean word: runs of consonants between vowels are cut before their longest onset."""
    parts = f"regexp_extract_all({w}, '{_V}|{_N}+')"
    vowel = lambda x: f"regexp_matches({x}, '^{_V}')"
    p = f"list_transform(list_zip({parts}, list_concat([''], ({parts})[:-2]), range(1, len({parts}) + 1)), lambda z: case when {vowel('z[1]')} then case when z[2] <> '' and {vowel('z[2]')} then '-' || z[1] else z[1] end when z[3] = 1 or z[3] = len({parts}) then z[1] when length(z[1]) = 1 then '-' || z[1] when z[1][1] = z[1][2] then z[1][1] || '-' || z[1][2:] else regexp_replace(z[1], '({_ON}|.)$', '-\\1') end)"
    return f"case when regexp_matches({w}, '{_V}') then string_split(array_to_string({p}, ''), '-') else [] end"


_SYLLABLES = f"with {_VOCAB}, syl as (select word, c, {_syllables('c')} as s from cleaned)"


def _words(spark, sf_dir):
    return c.spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(tx.words(F.col("text"))).alias("word"))


def _vocab(spark, sf_dir):
    return _words(spark, sf_dir).distinct()


@query(f"{_SYLLABLES} select word, array_to_string(s, '-') as syllables, cast(len(s) as integer) as n from syl")
def tr_syllables(spark, sf_dir):
    v = _vocab(spark, sf_dir).select("word", c.once(sy.clean(F.col("word"))).alias("c")).withColumn("s", sy.of_clean(F.col("c")))
    return v.select("word", F.array_join("s", "-").alias("syllables"), F.size("s").alias("n"))


_EXC = "map {" + ", ".join(f"'{k}': {v}" for k, v in sy.EXCEPTIONS.items()) + "}"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_STRESS = f"""case when len(s) = 0 then null when len(s) = 1 then 0 when s[-1] in {_LIST(sy.QUESTION)} then len(s) - 2
 when {_EXC}[replace(lower(word), '''', '')] < len(s) then {_EXC}[replace(lower(word), '''', '')] when s[-1] in {_LIST(sy.NEUTRAL)} then len(s) - 2 else len(s) - 1 end"""


@query(f"{_SYLLABLES} select word, coalesce(cast({_STRESS} as integer), -1) as position, array_to_string(list_transform(s, lambda x, i: case when i - 1 = ({_STRESS}) then '''' || x else x end), '-') as stressed from syl")
def tr_stress(spark, sf_dir):
    v = _vocab(spark, sf_dir).withColumn("s", sy.syllables(F.col("word")))
    return v.select("word", F.coalesce(sy.stress_index(F.col("s"), F.col("word")), F.lit(-1)).alias("position"), F.array_join(sy.add_stress(F.col("s"), F.col("word")), "-").alias("stressed"))


_BACK = "".join(v for v in sy.VOWELS if v not in sy.FRONT)
_HARMONY = f"(select word, length(regexp_replace(lower(word), '[^{sy.FRONT}]', '', 'g')) as f, length(regexp_replace(lower(word), '[^{_BACK}]', '', 'g')) as b from vocab)"


@query(f"with {_VOCAB} select word, cast(f as integer) as front, cast(b as integer) as back, f + b > 0 and not (f > 0 and b > 0) as valid, case when f + b = 0 then 'Invalid word - no vowels' when f + b = 1 then 'Single vowel - trivially harmonic' when f > 0 and b > 0 then '{sy.MIXED}' when f > 0 then 'All front vowels - harmonic' else 'All back vowels - harmonic' end as note from {_HARMONY}")
def tr_harmony(spark, sf_dir):
    return _vocab(spark, sf_dir).withColumn("h", sy.harmony(F.col("word"))).select("word", "h.*")


@query(f"with {_VOCAB} select word, cast(length(regexp_replace(lower(word), '{_N}', '', 'g')) as integer) as n from vocab")
def tr_count_syllables(spark, sf_dir):
    return _vocab(spark, sf_dir).select("word", sy.count(F.col("word")).alias("n"))


@query(f"{_SYLLABLES} select word, len(s) > 0 and s[-1] in {_LIST(sy.NEUTRAL)} as neutral, len(s) > 0 and s[-1] in {_LIST(sy.QUESTION)} as question from syl")
def tr_suffixes(spark, sf_dir):
    v = _vocab(spark, sf_dir).withColumn("s", sy.syllables(F.col("word")))
    return v.select("word", sy.has_neutral_suffix(F.col("s")).alias("neutral"), sy.is_question(F.col("s")).alias("question"))


_LETTERS = f"regexp_replace(lower(word), '[^{sy.VOWELS}{sy.CONSONANTS}]', '', 'g')"


@query(
    f"""with {_VOCAB}, l as (select word, {_LETTERS} as t from vocab), h as (select word, t, length(regexp_replace(t, '[^{sy.FRONT}]', '', 'g')) as f, length(regexp_replace(t, '[^{_BACK}]', '', 'g')) as b from l)
select word, case when f + b = 0 then 'No vowels found' when f > 0 and b > 0 then 'Vowel harmony issue: {sy.MIXED}' else '' end as issues from h"""
)
def tr_validate(spark, sf_dir):
    return _vocab(spark, sf_dir).select("word", F.array_join(sy.issues(F.col("word"), True), "; ").alias("issues"))


_TARGETS = f"targets as (select distinct ({words('text')})[1] as word from benchmark)"


@query(
    f"""with {_VOCAB}, {_TARGETS}, every as (select word, {_CLEAN} as c from (select word from vocab union select word from targets)), syl as (select word, {_syllables('c')} as s from every),
pairs as (select a.word, b.word as rhyme, list_reverse(a.s) as x, list_reverse(b.s) as y from syl a join targets t on t.word = a.word join syl b on a.s[-1] = b.s[-1] and lower(a.word) <> lower(b.word) join vocab v on v.word = b.word where len(a.s) > 0),
m as (select word, rhyme, cast(coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) as integer) as matching from pairs)
select word, rhyme, matching, cast(row_number() over (partition by word order by matching desc, rhyme) as integer) as rank from m"""
)
def tr_rhymes(spark, sf_dir):
    """The rhymes of the first word of each benchmark item among all words, best first."""
    first = table(spark, sf_dir, "benchmark").select(F.try_element_at(tx.words(F.col("text")), F.lit(1)).alias("word")).distinct()
    return words_op.rhymes(first, _vocab(spark, sf_dir))


@query(
    f"""{_SYLLABLES}, r as (select word, list_reverse(s) as x from syl where len(s) > 0), pairs as (select a.word, b.word as rhyme, a.x, b.x as y from r a join r b on a.x[1] = b.x[1] and lower(a.word) <> lower(b.word)),
m as (select word, rhyme, cast(coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) as integer) as matching from pairs)
select word, rhyme, matching, cast(row_number() over (partition by word order by matching desc, rhyme) as integer) as rank from m qualify rank <= 3"""
)
def tr_best_rhymes(spark, sf_dir):
    """The three best rhymes of every word."""
    return words_op.best_rhymes(_vocab(spark, sf_dir), 3)


@query(f"{_SYLLABLES} select word, s[-1] as rhyme, array_to_string(list_transform(range(1, len(s) + 1), lambda n: array_to_string(s[len(s) - n + 1:], '-')), ' ') as tails from syl where len(s) > 0")
def tr_rhyme_classes(spark, sf_dir):
    """Every word with a syllable and its tails, from the last syllable to the whole word: words rhyme by n syllables if their n-th
    tails are equal."""
    v = _vocab(spark, sf_dir).withColumn("s", c.once(sy.syllables(F.col("word")))).where(F.size("s") > 0)
    tails = F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice("s", -n, n), "-"))
    return v.select("word", F.element_at("s", -1).alias("rhyme"), F.array_join(tails, " ").alias("tails"))


@query(
    f"""{_SYLLABLES}, freq as (select word, count(*) as n from (select unnest({words('text')}) as word from documents) group by word), pieces as (select n, unnest(list_transform(s, lambda x, i: case when i = 1 then '▁' || x else x end)) as syllable from syl join freq using (word))
select 'tr' as lang, syllable, cast(sum(n) as bigint) as frequency from pieces group by syllable"""
)
def syllable_freq(spark, sf_dir):
    """Weighted syllables, with every word read as Turkish."""
    w = _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("frequency"))
    return c.syllable_frequency(w.withColumn("lang", F.lit("tr")))


@query(f"select 'tr' as lang, syllable, frequency, cast(rank as integer) as rank from (select *, row_number() over (order by frequency desc, syllable) as rank from ({SQL['syllable_freq']})) where rank <= 10")
def syllable_top10(spark, sf_dir):
    return c.top(syllable_freq(spark, sf_dir), 10, "frequency", "syllable", "lang")


def _three(n: str, space: str = "") -> str:
    units, tens = (f"[{', '.join(repr(x) for x in xs)}]" for xs in (tr.UNITS, tr.TENS))
    if not space:
        return f"(case when {n} // 100 > 1 then {units}[{n} // 100 + 1] else '' end || case when {n} // 100 > 0 then 'yüz' else '' end || {tens}[({n} % 100) // 10 + 1] || {units}[{n} % 10 + 1])"
    return f"[case when {n} // 100 > 1 then {units}[{n} // 100 + 1] || ' yüz' when {n} // 100 = 1 then 'yüz' else '' end, {tens}[({n} % 100) // 10 + 1], {units}[{n} % 10 + 1]]"


def _number(n: str) -> str:
    groups = [f"({n} // {1000**k} % 1000)" for k in range(6, -1, -1)]
    parts = [f"case when {g} = 0 then '' when {6 - i} = 1 and {g} = 1 then 'bin' else {_three(g)} || '{tr.SCALES[6 - i]}' end" for i, g in enumerate(groups)]
    return f"case when {n} = 0 then 'sıfır' else {' || '.join(parts)} end"


_NUMBERS = "numbers as (select distinct cast(o_orderkey as bigint) * k as n from orders, (values (0), (1), (1000), (100003), (99990000001)) t(k))"


def _numbers(spark, sf_dir):
    o = c.spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")))
    return o.select(F.explode(F.array(*(F.col("k") * F.lit(x).cast("long") for x in (0, 1, 1000, 100003, 99990000001)))).alias("n")).distinct()


@query(f"with {_NUMBERS} select n, {_number('n')} as said from numbers")
def num_words_tr(spark, sf_dir):
    return _numbers(spark, sf_dir).select("n", tr.number_words(F.col("n").cast("string")).alias("said"))


_ORDINAL = f"""(select n, said, regexp_extract(said, '([aıoueiüö])[^aıoueiüö]*$', 1) as v from (select n, {_number('n')} as said from numbers))"""


@query(
    f"""with {_NUMBERS} select n, case when n between 1 and 10 then [{', '.join(repr(x) for x in tr.FIRST_ORDINALS)}][n] else said ||
 case when regexp_matches(said, '[aıuoeiüö]$') then 'n' || substr(s, 3, 2) else s end end as said from (select *, case when v in ('a', 'ı') then 'ıncı' when v in ('e', 'i') then 'inci' when v in ('o', 'u') then 'uncu' else 'üncü' end as s from {_ORDINAL})"""
)
def ordinal_tr(spark, sf_dir):
    return _numbers(spark, sf_dir).select("n", tr.ordinal_words(F.col("n").cast("string")).alias("said"))


def _spoken(n: str) -> str:
    groups = [f"({n} // {1000**k} % 1000)" for k in range(4, -1, -1)]
    parts = [f"case when {g} = 0 then [] when {4 - i} = 1 and {g} = 1 then ['bin'] else list_concat({_three(g, ' ')}, ['{tr.SCALES[4 - i]}']) end" for i, g in enumerate(groups)]
    return f"case when {n} >= 1000000000000000 then cast({n} as varchar) when {n} = 0 then 'sıfır' else array_to_string(list_filter(flatten([{', '.join(parts)}]), lambda w: w <> ''), ' ') end"


@query(f"with {_NUMBERS} select n, {_spoken('n')} as said, 'eksi ' || {_spoken('n')} as negative from numbers where n > 0 union all select 0, 'sıfır', 'sıfır'")
def spoken_number_tr(spark, sf_dir):
    return _numbers(spark, sf_dir).select("n", tr.spoken_number(F.col("n")).alias("said"), tr.spoken_number(-F.col("n")).alias("negative"))


def _texts(text: Column, spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.alias("out"))


@query()
def wordify_tr(spark, sf_dir):
    return _texts(tr.wordify(F.col("text"), True), spark, sf_dir)


@query("select doc_id, translate(text, 'ýÝðÐþÞ', 'ıİğĞşŞ') as out from documents")
def repaired_encoding(spark, sf_dir):
    return _texts(tr.repair(F.col("text")), spark, sf_dir)


@query("select doc_id, replace(upper(translate(text, 'iı', 'İI')), 'ẞ', 'SS') as out from documents")
def upper_tr(spark, sf_dir):
    return _texts(tr.upper(F.col("text")), spark, sf_dir)


@query(f"select ord::bigint as id, phoneme, n from ({met_sql(list(ph.VOCABULARY), 'phoneme')})")
def phoneme_vocabulary(spark, sf_dir):
    """The phonemes by id, and how many documents show each as a character."""
    return met(spark, sf_dir, list(ph.VOCABULARY), "phoneme").select(F.col("ord").cast("long").alias("id"), "phoneme", "n")


_PAUSED = "text"
for _mark, _pause in ph.PAUSES.items():
    _PAUSED = f"replace({_PAUSED}, '{_mark}', '{_pause}')"


@query(f"select doc_id, {_PAUSED} as out from documents")
def prosody(spark, sf_dir):
    return _texts(ph.prosody(F.col("text")), spark, sf_dir)


@query("select doc_id, case when lang = 'en' then '<EMOTION_HAPPY> ' || source || ' <EMOTION_END>' when lang = 'de' then '<EMOTION_CALM> ' || source || ' <EMOTION_END>' else source end as out from documents")
def emotion_markers(spark, sf_dir):
    name = F.when(F.col("lang") == "en", "happy").when(F.col("lang") == "de", "calm").when(F.col("lang") == "fr", "neutral").otherwise("bored")
    return documents(spark, sf_dir).select("doc_id", ph.emotion(F.col("source"), name).alias("out"))


_IDS = "map {" + ", ".join("'" + p.replace("'", "''") + f"': {i}" for i, p in enumerate(ph.VOCABULARY)) + "}"
_ANY = "|".join(p for p in ph.VOCABULARY if len(p) > 2) + "|" + "|".join(p for p in ph.VOCABULARY if len(p) == 2) + "|."
_PHONEME_IDS = f"list_transform(regexp_extract_all(lower(text), '(?s){_ANY}'), lambda p: coalesce({_IDS}[p], 1))"


@query(f"with x as (select item_id, {_PHONEME_IDS} as ids from benchmark) select item_id, array_to_string(ids, ' ') as ids, cast(len(ids) as integer) as n, array_to_string(list_transform(ids, lambda i: {'[' + ', '.join(chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in ph.VOCABULARY) + ']'}[i + 1]), '') as phonemes from x")
def phoneme_ids(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("ids", ph.to_ids(F.lower("text")))
    return b.select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.size("ids").alias("n"), ph.to_phonemes(F.col("ids")).alias("phonemes"))


@query(
    f"with x as (select item_id, {_PHONEME_IDS} as ids from benchmark), m as (select max(len(ids)) as n from x), p as (select item_id, list_concat(ids, list_transform(range(0, n - len(ids)), lambda i: 0)) as ids from x, m) select item_id, array_to_string(ids, ' ') as ids, array_to_string(list_transform(ids, lambda i: case when i = 0 then 0 else 1 end), '') as mask from p"
)
def pad_mask(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("ids", ph.to_ids(F.lower("text")))
    longest = b.agg(F.max(F.size("ids")).alias("n"))
    p = b.crossJoin(F.broadcast(longest)).select("item_id", ph.pad(F.col("ids"), F.col("n")).alias("ids"))  # one row
    return p.select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.array_join(ph.mask(F.col("ids")).cast("array<string>"), "").alias("mask"))
