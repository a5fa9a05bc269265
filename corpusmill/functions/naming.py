"""File names and small lookups as expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes of the language registry, in order, those of a later list again where both hold them.
PRIORITY = ["zh", "en", "tr", "es"]
TURKISH, PLAIN = "çÇğĞıIİöÖşŞüÜ", "cCgGiIIoOsSuU"
REMOVED = string.punctuation.replace("_", "").replace("-", "")
FILL_DOCUMENT = "Please fill all fields (Genre, Author, and Title)."
FILL_AUDIOBOOK = "Please fill all fields (Source, Narrator, Genre, Author, and Title)."


def plain(text: Column) -> Column:
    """Turkish letters as ASCII, hyphens as spaces, without other punctuation but underscores."""
    return F.translate(F.translate(text, TURKISH + "-", PLAIN + " "), REMOVED, "")


def titled(text: Column) -> Column:
    """Words of plain text, each capitalised, joined by underscores."""
    words = F.filter(F.split(plain(text), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "_")


def _filled(*parts: Column) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & (F.coalesce(p, F.lit("")) != "")
    return ok


def document_name(genre: Column, author: Column, title: Column) -> Column:
    return F.when(_filled(genre, author, title), F.concat_ws("-", genre, titled(author), titled(title))).otherwise(FILL_DOCUMENT)


def audiobook_name(source: Column, narrator: Column, genre: Column, author: Column, title: Column) -> Column:
    name = F.concat_ws("-", F.lit("Audiobook"), titled(source), titled(narrator), genre, titled(author), titled(title))
    return F.when(_filled(source, narrator, genre, author, title), name).otherwise(FILL_AUDIOBOOK)


def translated(key: Column, words: dict[str, str]) -> Column:
    """The word of a key, or the key."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), key), key) if words else key


def language_ids(codes: list[str]) -> dict[str, int]:
    """The id of a code is its last place in the list plus 3."""
    return {code: i + 3 for i, code in enumerate(codes)}


def language_id(code: Column, codes: list[str]) -> Column:
    """0 for what is not in the list."""
    ids = F.create_map(*(F.lit(x) for kv in language_ids(codes).items() for x in kv))
    return F.coalesce(F.try_element_at(ids, code), F.lit(0))


def percent(done: Column, total: Column) -> Column:
    return F.floor(done / total * 100).cast("int")


def relative(path: Column, base: str) -> Column:
    """Below base, with forward slashes."""
    import re

    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^{re.escape(base.rstrip('/'))}/", "")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def route(name: Column) -> Column:
    """Where an upload goes by its extension; null if it is skipped."""
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".txt"), "txt")


def renamed_key(key: Column, renames: dict[str, str] | None = None) -> Column:
    """A checkpoint key without the prefixes of wrappers."""
    for old, new in {"module.": "", "_orig_mod.": "", **(renames or {})}.items():
        key = F.replace(key, F.lit(old), F.lit(new))
    return key
