"""Turkish numbers, wordifier and normalizer as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import graphemes, keep_only, let, nfc, replace_all, replace_matches, set_apart, squeeze, strip

#: Fixed values.
UNITS = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
SCALES = ["", "bin", "milyon", "milyar", "trilyon", "katrilyon", "kentilyon"]
MONTHS = ["ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık"]
FIRST_ORDINALS = ["birinci", "ikinci", "üçüncü", "dördüncü", "beşinci", "altıncı", "yedinci", "sekizinci", "dokuzuncu", "onuncu"]
ABBREVIATIONS = {
    "vs.": "vesaire", "vb.": "ve benzeri", "vd.": "ve diğerleri", "bkz.": "bakınız", "yy.": "yüzyıl",
    "m.ö.": "milattan önce", "m.s.": "milattan sonra", "m.ö": "milattan önce", "m.s": "milattan sonra",
    "dr.": "doktor", "prof.": "profesör", "doç.": "doçent", "arş. gör.": "araştırma görevlisi", "öğr. gör.": "öğretim görevlisi",
    "uzm.": "uzman", "yrd. doç.": "yardımcı doçent", "alb.": "albay", "org.": "orgeneral", "av.": "avukat", "müh.": "mühendis",
    "t.c.": "türkiye cumhuriyeti", "a.ş.": "anonim şirketi", "ltd.": "limited", "şti.": "şirketi", "san.": "sanayi",
    "tic.": "ticaret", "mah.": "mahallesi", "cad.": "caddesi", "sok.": "sokağı", "no.": "numara", "tel.": "telefon",
    "nbr.": "ne haber", "slm.": "selam", "tmm.": "tamam", "hz.": "hazreti", "r.a.": "radıyallahu anh", "a.s.": "aleyhisselam",
    "s.a.v.": "sallallahu aleyhi ve sellem", "kg.": "kilogram", "gr.": "gram", "lt.": "litre", "ml.": "mililitre",
    "cm.": "santimetre", "mm.": "milimetre", "km.": "kilometre",
}
KEEPS = [
    "a", "â", "b", "c", "ç", "d", "e", "ê", "f", "g", "ğ", "h", "ı", "i", "î",
    "j", "k", "l", "m", "n", "o", "ô", "ö", "p", "q", "r", "s", "ş", "t", "u",
    "û", "ū", "ü", "v", "w", "x", "y", "z", ".", ",", "?", "!", ":", ";", "'",
    "(", ")", "[", "]", " ", "-", "0", "1", "2", "3", "4", "5", "6", "7", "8", "9",
    "ə", "ñ", "ŋ", "ň", "ý", "ä", "ë", "ă", "ĕ", "ś", "ÿ", "ž", "ʻ", "’",
]
LOOK_ALIKES = {"’": "'", "‘": "'", "`": "'", "´": "'", "“": '"', "”": '"', "«": '"', "»": '"', "–": "-", "—": "-", "−": "-", "~": "-", "…": "...", "\n": " ", "\t": " "}

WORD_EDGE = r"(?U)\b"


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _below_thousand(n: Column) -> tuple[Column, Column]:
    """The words of the hundreds and of what is below, each from a list."""
    hundreds = ["", "yüz"] + [u + "yüz" for u in UNITS[2:]]
    return _pick(hundreds, (n / 100).cast("int")), _pick([t + u for t in TENS for u in UNITS], n % 100)


def _group_words(three: Column, scale: Column) -> Column:
    said = F.concat(*_below_thousand(three), _pick(SCALES, scale))
    return F.when(three == 0, "").when((scale == 1) & (three == 1), "bin").otherwise(said)


def number_words(digits: Column) -> Column:
    """The words of a string of digits, written together; beyond 21 digits one word for each, with spaces."""

    def said(n: Column) -> Column:
        one_by_one = F.array_join(F.transform(F.regexp_extract_all(n, F.lit("."), F.lit(0)), lambda d: F.when(d == "0", "sıfır").otherwise(_pick(UNITS, d.cast("int")))), " ")
        scales = F.sequence(((F.length(n) - 1) / 3).cast("int"), F.lit(0), F.lit(-1))  # groups that the number has
        groups = let(F.lpad(n, 21, "0"), lambda whole: F.array_join(F.transform(scales, lambda k: let(F.substring(whole, 19 - 3 * k, F.lit(3)).cast("int"), lambda three: _group_words(three, k))), ""))
        return F.when(n == "", "sıfır").when(F.length(n) > 21, one_by_one).otherwise(groups)

    return let(F.ltrim(digits, F.lit("0")), said)


def _with_suffix(base: Column) -> Column:
    vowel = F.regexp_extract(base, "([aıoueiüö])[^aıoueiüö]*$", 1)
    close = let(vowel, lambda v: F.when(v.isin("a", "ı"), "ıncı").when(v.isin("e", "i", ""), "inci").when(v.isin("o", "u"), "uncu").otherwise("üncü"))
    return F.concat(base, F.when(base.rlike("[aıuoeiüö]$"), F.concat(F.lit("n"), F.substring(close, 3, 2))).otherwise(close))


def ordinal_words(digits: Column) -> Column:
    first = F.create_map(*(x for i, w in enumerate(FIRST_ORDINALS) for x in (F.lit(str(i + 1)), F.lit(w))))
    return F.coalesce(F.try_element_at(first, F.regexp_replace(digits, "^0+", "")), let(number_words(digits), _with_suffix))


def _folded(x: Column) -> Column:
    """Letters that are the same in any case, so that what a short form matches has its folded form."""
    return F.lower(F.translate(x, "İıſ\u212a", "iisk"))


def expand_abbreviations(text: Column) -> Column:
    """Longest first, in any case. Only the forms that a text holds are looked for by pattern."""
    fold = lambda x: x.replace("ı", "i")
    rules = F.array(*(F.struct(F.lit(fold(short)).alias("short"), F.lit(rf"(?iuU)\b{re.escape(short)}(?=\s|[.,!?]|$)").alias("pattern"), F.lit(long).alias("long")) for short, long in sorted(ABBREVIATIONS.items(), key=lambda x: -len(x[0]))))

    def expanded(t: Column) -> Column:
        held = let(_folded(t), lambda low: F.filter(rules, lambda r: F.contains(low, r["short"])))
        return F.aggregate(held, t, lambda out, r: F.regexp_replace(out, r["pattern"], r["long"]))

    return let(text, expanded)


def repair(text: Column) -> Column:
    """Letters of a mistaken encoding."""
    return F.translate(text, "ýÝðÐþÞ", "ıİğĞşŞ")


def say_dates(text: Column) -> Column:
    def said(m: Column) -> Column:
        part = F.split(m, "[./-]")
        month = F.lpad(part[1], 2, "0")
        name = F.coalesce(F.try_element_at(F.create_map(*(x for i, v in enumerate(MONTHS) for x in (F.lit(f"{i + 1:02}"), F.lit(v)))), month), F.lit(""))
        return F.concat_ws(" ", number_words(part[0]), name, number_words(part[2]))

    return replace_matches(text, r"(?U)\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\b", said)


def say_times(text: Column) -> Column:
    return replace_matches(text, r"(?U)\b(?:[01]?[0-9]|2[0-3])[:.][0-5][0-9]\b", lambda m: F.concat(number_words(F.split(m, "[:.]")[0]), number_words(F.split(m, "[:.]")[1])))


def join_thousands(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)([0-9])\.(?=[0-9]{3}(?:\b|[^0-9]))", "$1")


def say_ordinals(text: Column) -> Column:
    return replace_matches(text, r"(?iuU)\b[0-9]+(?:\.(?![0-9])|['’]?(?:inci|nci|uncu|üncü))", lambda m: ordinal_words(F.regexp_extract(m, "^[0-9]+", 0)))


def say_numbers(text: Column) -> Column:
    return replace_matches(text, r"(?U)\b[0-9]+\b", number_words)


def say_glued(text: Column) -> Column:
    """Digits next to letters are split off and said; what digits are left go."""
    text = F.regexp_replace(text, r"(?U)\b([0-9]+)([\p{L}\p{M}]+)", "$1 $2")
    text = F.regexp_replace(text, r"(?U)\b([\p{L}\p{M}]+)([0-9]+)\b", "$1 $2")
    return F.regexp_replace(say_numbers(text), r"[0-9]+", "")


def wordify(text: Column, abbreviations: bool = False) -> Column:
    text = repair(nfc(text))
    text = expand_abbreviations(text) if abbreviations else text

    def said(t: Column) -> Column:
        out = t
        for step in (say_dates, say_times, join_thousands, say_ordinals, say_numbers, say_glued):
            out = step(out)
        return F.when(t.rlike("[0-9]"), out).otherwise(t)  # all of these rules are about digits

    return strip(squeeze(let(text, said)))


def lower(text: Column) -> Column:
    return F.lower(replace_all(text, {"I": "ı", "İ": "i"}))  # others have one lower form anywhere


def upper(text: Column) -> Column:
    return F.upper(F.translate(text, "iı", "İI"))


def normalize(text: Column, wordified: bool = False, abbreviations: bool = False, extract: bool = False, to_upper: bool = False) -> Column:
    text = wordify(text, abbreviations) if wordified else text
    text = lower(replace_all(text, LOOK_ALIKES))
    text = F.regexp_replace(text, r"(?U)([^\w\s.])\1+", "$1")
    text = F.regexp_replace(squeeze(text), r"(?U)(?:\.\s*){2,}", " ^ ")
    text = F.replace(F.replace(set_apart(text), F.lit("^"), F.lit("...")), F.lit('"'), F.lit("''"))
    text = strip(keep_only(squeeze(text), "".join(KEEPS)))
    text = graphemes(text) if extract else text
    return strip(upper(text) if to_upper else text)


def spoken_number(n: Column) -> Column:
    """A long's words with spaces; negatives begin with eksi, from 10^15 on the digits stay."""
    hundreds = ["", "yüz"] + [f"{u} yüz" for u in UNITS[2:]]
    below = [" ".join(x for x in (t, u) if x) for t in TENS for u in UNITS]
    none = F.lit(None).cast("string")

    def group(size: Column, k: Column) -> Column:
        def said(three: Column) -> Column:
            parts = (_pick(hundreds, (three / 100).cast("int")), _pick(below, three % 100), _pick(SCALES, k))
            return F.when(three == 0, none).when((k == 1) & (three == 1), "bin").otherwise(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))

        return let((F.substring(F.lpad(size.cast("string"), 15, "0"), 13 - 3 * k, F.lit(3))).cast("int"), said)

    def whole(n: Column) -> Column:
        def said(size: Column) -> Column:
            scales = F.sequence(((F.length(size.cast("string")) - 1) / 3).cast("int"), F.lit(0), F.lit(-1))
            words = F.array_join(F.transform(scales, lambda k: group(size, k)), " ")  # nulls are left out
            return F.when(size >= 10**15, size.cast("string")).when(size == 0, "sıfır").otherwise(words)

        return let(F.abs(n), lambda size: F.when(n < 0, F.concat(F.lit("eksi "), said(size))).otherwise(said(size)))

    return let(n, whole)
