"""Turkish phonemes as expressions: spoken forms, markers, letters to phonemes, phonemes to ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import syllables as sy
from .text import let, replace_all, replace_matches
from .turkish import MONTHS, spoken_number

#: Fixed values.
LETTERS = {"a": "a", "b": "b", "c": "j", "ç": "ch", "d": "d", "e": "e", "f": "f", "g": "g", "ğ": "gh", "h": "h", "ı": "uh", "i": "i", "j": "zh", "k": "k", "l": "l", "m": "m", "n": "n", "o": "o", "ö": "oe", "p": "p", "r": "r", "s": "s", "ş": "sh", "t": "t", "u": "u", "ü": "ue", "v": "v", "y": "y", "z": "z", "w": "v"}
SPECIAL = ["<PAD>", "<UNK>", "<SOS>", "<EOS>", " ", "-", "'", "<PAUSE_SHORT>", "<PAUSE_MED>", "<PAUSE_LONG>", "<EMPHASIS>", "<RISING>", "<URL>", "<EMAIL>", "<EMOTION_HAPPY>", "<EMOTION_SAD>", "<EMOTION_ANGRY>", "<EMOTION_EXCITED>", "<EMOTION_CALM>", "<EMOTION_END>"]
PHONEMES = [
    "a", "b", "ch", "d", "e", "f", "g", "gh", "h", "i", "j", "k", "l", "m", "n", "o", "oe", "p", "r", "s", "sh", "t", "u", "ue", "uh", "v", "y", "z",
    "zh",
]
VOCABULARY = SPECIAL + PHONEMES
CONTRACTIONS = {"ne'dir": "nedir", "ne'ye": "neye", "yapıyo": "yapıyor", "geliyo": "geliyor"}
PAUSES = {".": " <PAUSE_LONG>", ",": " <PAUSE_SHORT>", ";": " <PAUSE_MED>", "!": " <PAUSE_LONG> <EMPHASIS>", "?": " <PAUSE_LONG> <RISING>", ":": " <PAUSE_MED>"}
READABLE = {"<PAUSE_SHORT>": ",", "<PAUSE_MED>": ";", "<PAUSE_LONG>": ".", "<EMPHASIS>": "!", "<RISING>": "?", "<SOS>": "", "<EOS>": "", "<PAD>": ""}
EMOTIONS = ["neutral", "happy", "sad", "angry", "excited", "calm"]
PAD, UNKNOWN, START, END = range(4)


def _of(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def contractions(text: Column) -> Column:
    return replace_all(text, CONTRACTIONS)


def _long(digits: Column) -> Column:
    return digits.cast("long")


def say_dates(text: Column) -> Column:
    def said(m: Column) -> Column:
        p = F.split(m, "[./]")
        month = F.coalesce(F.try_element_at(_of({f"{i + 1:02}": v for i, v in enumerate(MONTHS)}), F.lpad(p[1], 2, "0")), p[1])
        return F.concat_ws(" ", spoken_number(_long(p[0])), month, spoken_number(_long(p[2])))

    return replace_matches(text, r"(?U)\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}\b", said)


def say_times(text: Column) -> Column:
    return replace_matches(text, r"(?U)\b[0-9]{1,2}:[0-9]{2}\b", lambda m: F.concat_ws(" ", F.lit("saat"), spoken_number(_long(F.split(m, ":")[0])), spoken_number(_long(F.split(m, ":")[1]))))


def _amount(match: Column) -> Column:
    return F.replace(F.regexp_extract(match, r"^[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit("."))


def say_currency(text: Column) -> Column:
    def said(amount: Column) -> Column:
        lira = F.floor(amount)
        kurus = let(F.bround((amount - lira) * 100).cast("long"), lambda cents: F.when(cents > 0, F.concat(F.lit(" "), spoken_number(cents), F.lit(" kuruş"))).otherwise(""))
        return F.concat(spoken_number(lira), F.lit(" lira"), kurus)

    return replace_matches(text, r"(?U)[0-9]+(?:[.,][0-9]+)?\s*₺", lambda m: let(_amount(m).cast("double"), said))


def say_percent(text: Column) -> Column:
    def said(n: Column) -> Column:
        return F.concat(F.lit("yüzde "), F.when(n.cast("double") == F.floor(n.cast("double")), spoken_number(F.floor(n.cast("double")))).otherwise(F.replace(n, F.lit("."), F.lit(" nokta "))))

    return replace_matches(text, r"(?U)[0-9]+(?:[.,][0-9]+)?\s*%", lambda m: let(_amount(m), said))


def mark_addresses(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?U)https?://\S+", "<URL>")
    return F.regexp_replace(text, r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "<EMAIL>")


def say_numbers(text: Column) -> Column:
    return replace_matches(text, r"(?U)\b[0-9]+\b", lambda m: F.when(F.length(m) > 18, m).otherwise(spoken_number(_long(F.when(F.length(m) > 18, F.lit("0")).otherwise(m)))))


def normalize(text: Column, abbreviations: dict[str, str] | None = None) -> Column:
    for step in (contractions, say_dates, say_times, say_currency, say_percent, mark_addresses, say_numbers):
        text = step(text)
    return replace_all(text, dict(sorted((abbreviations or {}).items(), key=lambda x: -len(x[0]))))


def prosody(text: Column) -> Column:
    return replace_all(text, PAUSES)


def emotion(text: Column, name: Column) -> Column:
    """Markers around the text; none for neutral and for what is no emotion."""
    return F.when(name.isin(EMOTIONS[1:]), F.concat(F.lit("<EMOTION_"), F.upper(name), F.lit("> "), text, F.lit(" <EMOTION_END>"))).otherwise(text)


def of_syllable(syllable: Column) -> Column:
    """The phonemes of a syllable; the stress mark stays, other characters go."""
    known = _of(LETTERS | {"'": "'"})
    return F.array_join(F.transform(F.split(syllable, ""), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(""))), "")


def tokens(text: Column, with_prosody: bool = True) -> Column:
    """array<struct<word, marker, phonemes>>: markers as they are, words as stressed phonemes by syllable."""
    text = prosody(text) if with_prosody else text
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    marked = F.transform(parts, lambda w: F.struct(w.alias("word"), w.rlike("^<.*>$").alias("marker"), F.regexp_replace(F.lower(w), r"(?U)[^\w\s]", "").alias("clean")))
    said = F.transform(marked, lambda x: F.struct(x["word"].alias("word"), x["marker"].alias("marker"), F.when(x["marker"], F.array(x["word"])).otherwise(F.transform(sy.add_stress(sy.syllables(x["clean"]), x["clean"]), of_syllable)).alias("phonemes"), x["clean"].alias("clean")))
    return F.transform(F.filter(said, lambda x: x["marker"] | (x["clean"] != "")), lambda x: F.struct(x["word"].alias("word"), x["marker"].alias("marker"), x["phonemes"].alias("phonemes")))


def phoneme_string(text: Column, with_prosody: bool = True) -> Column:
    return F.array_join(F.transform(tokens(text, with_prosody), lambda x: F.array_join(x["phonemes"], "-")), " ")


def to_ids(phonemes: Column) -> Column:
    """Markers first, then two characters, then one; what is none of these is unknown."""
    two = sorted((p for p in VOCABULARY if len(p) == 2), key=VOCABULARY.index)
    found = F.regexp_extract_all(phonemes, F.lit(f"(?s){'|'.join(p for p in VOCABULARY if len(p) > 2)}|{'|'.join(two)}|."), F.lit(0))
    ids = _of({p: i for i, p in enumerate(VOCABULARY)})
    return F.transform(found, lambda p: F.coalesce(F.try_element_at(ids, p), F.lit(UNKNOWN)))


def to_phonemes(ids: Column) -> Column:
    names = F.array(*map(F.lit, VOCABULARY))
    return F.array_join(F.transform(ids, lambda i: F.when((i >= 0) & (i < len(VOCABULARY)), F.element_at(names, F.when((i >= 0) & (i < len(VOCABULARY)), i).otherwise(0).cast("int") + 1)).otherwise("<UNK>")), "")


def to_text(ids: Column) -> Column:
    return F.trim(replace_all(replace_all(to_phonemes(ids), {"'": "", "-": ""}), READABLE))


def framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(START)), ids, F.array(F.lit(END)))


def pad(ids: Column, length: Column, value: int = PAD) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))), F.lit(1), length.cast("int"))


def mask(ids: Column, value: int = PAD) -> Column:
    return F.transform(ids, lambda i: (i != value).cast("int"))


def first_invalid(ids: Column) -> Column:
    """The place of the first id that is not in the vocabulary; null if none."""
    at = F.array_position(F.transform(ids, lambda i: (i < 0) | (i >= len(VOCABULARY))), True)
    return F.when(at > 0, at - 1)


def durations(parts: Column) -> Column:
    """Milliseconds of each syllable's phonemes, or of a marker."""

    def of(x: Column) -> Column:
        pause = F.when(F.contains(x, F.lit("PAUSE_SHORT")), 150).when(F.contains(x, F.lit("PAUSE_MED")), 250).when(F.contains(x, F.lit("PAUSE_LONG")), 400).otherwise(0)
        return F.when(x.startswith("<"), pause).when(x.rlike("[aeıioöuü]"), F.when(x.startswith("'"), 96).otherwise(80)).otherwise(60)

    return F.transform(parts, of)


def text_to_ids(text: Column, frame: bool = False, normalized: bool = True) -> Column:
    """Normalisation, phonemes and ids in one."""
    ids = to_ids(phoneme_string(normalize(text) if normalized else text))
    return framed(ids) if frame else ids
