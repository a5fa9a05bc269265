"""Text normalisation as expressions: Column in, Column out, no Python on the rows but for composing accents.

Patterns are read with Unicode classes. Null texts stay null unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the English and Spanish rules keep.
ENGLISH_KEEPS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,!?:;'-()[] 0123456789"
SPANISH_KEEPS = "abcdefghijklmnñopqrstuvwxyzáéíóúüABCDEFGHIJKLMNÑOPQRSTUVWXYZÁÉÍÓÚÜ.,!?:;'-()[] ¿¡0123456789"
#: Literal expansions, in the order in which they apply.
ENGLISH_SHORT = {"Dr.": "Doctor", "Mr.": "Mister", "St.": "Street"}
SPANISH_SHORT = {"Sr.": "Señor", "Sra.": "Señora", "Dr.": "Doctor", "Dra.": "Doctora", "Av.": "Avenida"}
#: Ranges of characters that stand alone.
CJK = r"\u1100-\u11ff\u2e80-\ua4cf\ua840-\ud7af\uf900-\ufaff\ufe30-\ufe4f\uff65-\uffdc\x{20000}-\x{2ffff}"
#: Punctuation that is set apart.
MARKS, SPANISH_MARKS = "(),!?;:", "(),!?;:¿¡"


def one_of(characters: str) -> str:
    """The inside of a character class."""
    return "".join(re.escape(c) if ord(c) < 128 else c for c in dict.fromkeys(characters))


#: What (?U)\\s is.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def keep_only(text: Column, characters: str) -> Column:
    # the engine asks a class about its letters beyond Latin-1 one by one, and about what it shares with ASCII last
    first = one_of("".join(c for c in characters if ord(c) < 128))
    return F.regexp_replace(text, (f"(?![{first}])" if first else "") + f"[^{one_of(characters)}]", "")


def let(value: Column, body) -> Column:
    """body(x), in which x stands for value, computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_matches(text: Column, pattern: str, to) -> Column:
    """Every match replaced by to(match), an expression over its text."""

    def replaced(t: Column) -> Column:
        changed = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), to), F.array(F.lit("")))
        return F.when(t.rlike(pattern), F.array_join(F.zip_with(F.split(t, pattern, -1), changed, lambda a, b: F.concat(a, b)), "")).otherwise(t)

    return let(text, replaced)


#: Texts are composed if they have none but characters below U+0300, most punctuation and symbols, kana or CJK; others are looked at
#: one by one.
_MAYBE = r"[\x{300}-\x{200f}\x{20d0}-\x{2fff}\x{302a}-\x{302f}\x{3099}\x{309a}\x{3131}-\x{33ff}\x{a000}-\x{ff60}\x{ffa0}-\x{10ffff}]"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition. Only texts with a character that composing may change leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(_MAYBE), text)), text)


def graphemes(text: Column) -> Column:
    """Characters other than spaces, with a space between."""
    return F.array_join(F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: c != ""), " ")


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def set_apart(text: Column, marks: str = MARKS) -> Column:
    """A space after punctuation that something follows and before punctuation that follows something, numbers kept whole."""
    dot = r"\.(?!\.)"
    text = F.regexp_replace(text, rf"([{one_of(marks)}]|{dot})(?!(?<=[.,:])\d)(\S)", "$1 $2")
    # the mark is looked for before what is around it
    return F.regexp_replace(text, rf"(\S)(?=[.{one_of(marks)}])(?!(?<=\d)[.,:](?=\d))([{one_of(marks)}]|{dot})", "$1 $2")


def wordify_universal(text: Column) -> Column:
    return squeeze(strip(nfc(text)))


def normalize_universal(text: Column, extract: bool = False, upper: bool = False) -> Column:
    text = strip(squeeze(nfc(text)))
    text = graphemes(text) if extract else text
    return strip(F.upper(text) if upper else F.lower(text))


def wordify_english(text: Column, abbreviations: bool = False) -> Column:
    text = strip(text)
    text = replace_all(text, (ENGLISH_SHORT if abbreviations else {}) | {"$": " dollars "})
    return strip(squeeze(text))


def wordify_spanish(text: Column, abbreviations: bool = False) -> Column:
    text = strip(text)
    text = replace_all(text, (SPANISH_SHORT if abbreviations else {}) | {"$": " dólares ", "€": " euros "})
    return strip(squeeze(text))


def _normalize_western(text: Column, marks: str, keeps: str, extract: bool, upper: bool) -> Column:
    text = strip(keep_only(squeeze(set_apart(F.lower(text), marks)), keeps))
    text = graphemes(text) if extract else text
    return strip(F.upper(text) if upper else text)


def normalize_english(text: Column, extract: bool = False, upper: bool = False) -> Column:
    return _normalize_western(text, MARKS, ENGLISH_KEEPS, extract, upper)


def normalize_spanish(text: Column, extract: bool = False, upper: bool = False) -> Column:
    return _normalize_western(text, SPANISH_MARKS, SPANISH_KEEPS, extract, upper)


def isolate_cjk(text: Column) -> Column:
    """CJK characters with a space around, white space made one."""
    return strip(squeeze(F.regexp_replace(text, f"([{CJK}])", " $1 ")))


def without_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))
