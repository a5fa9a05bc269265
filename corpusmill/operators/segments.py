"""Segments of tokens and of recordings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that a segment may end with.
ENDS = [".", "!", "?", ",", ";", ":", "▁.", "▁!", "▁?", "▁,", "▁;", "▁:"]


def _stops(kinds: str, most: int) -> list[int]:
    """Where segments end. kinds: a character a token, 1 for what a segment may end with, 2 for the start of a word, 3 for both, else 0."""
    ends, begins = kinds.translate({51: "1"}), kinds.translate({51: "2"})
    out, at = [], 0
    while len(kinds) - at > most:
        limit = at + most
        least = max(at + most // 2, at + 10)
        end, begin = ends.rfind("1", least, limit), begins.rfind("2", least, limit)
        at = end + 1 if end >= 0 else begin if begin >= 0 else limit
        out.append(at)
    return out + ([len(kinds)] if at < len(kinds) else [])


def split_tokens(tokens: list[str], most: int = 120) -> list[list[str]]:
    """Segments of up to `most` tokens: cut after the last punctuation in the later half, else before the last word start, else hard."""
    stops = _stops("".join(str((t in ENDS) + 2 * t.startswith("▁")) for t in tokens), most)
    return [tokens[a:b] for a, b in zip([0, *stops], stops)]


def token_segments(rows: DataFrame, tokens: str, most: int = 120, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, segment_no, tokens). Only a character a token goes to Python; the tokens stay."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else _stops(t, most))

    one = lambda condition, value: F.when(condition, value).otherwise(0)
    kinds = F.array_join(F.transform(tokens, lambda t: (one(t.isin(ENDS), 1) + one(F.startswith(t, F.lit("▁")), 2)).cast("string")), "")
    found = rows.select(*keep, F.col(tokens).alias("_t"), cut(kinds).alias("_stops"))
    spans = F.transform("_stops", lambda stop, i: F.struct(F.when(i > 0, F.get("_stops", i - 1)).otherwise(0).alias("start"), stop.alias("stop")))
    each = found.select(*keep, "_t", F.posexplode(spans).alias("segment_no", "_s"))
    return each.select(*keep, "segment_no", F.slice("_t", F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start")).alias("tokens"))


def token_ids(rows: DataFrame, tokens: str, vocabulary: DataFrame, unknown: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, ids): tokens by the ids of vocabulary(piece, id), others unknown. Tokens are joined, not collected; a row's ids meet again by its key."""
    each = rows.select(*keep, F.posexplode(tokens).alias("_at", "piece"))
    found = each.join(vocabulary.select("piece", F.col("id").alias("_id")), "piece", "left")
    listed = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_id", F.lit(unknown)).alias("_id"))))
    return found.groupBy(*keep).agg(F.transform(listed, lambda x: x["_id"]).alias("ids"))


def voiced(levels: Column, silent: float, least: int, keep: int) -> Column:
    """array<struct<start, end>> of what lies between silences of `least` frames or more, with `keep` frames of them on both sides; all if none."""
    n = F.size(levels)
    loud = F.filter(F.transform(levels, lambda x, i: F.when(x > silent, i)), lambda i: i.isNotNull())

    def add(out: Column, i: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), (i + 1).alias("end"))
        return F.when((F.size(out) > 0) & (i - last["end"] < least), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(F.struct(i.alias("start"), (i + 1).alias("end")))))

    runs = F.aggregate(loud, F.expr("cast(array() as array<struct<start:int,end:int>>)"), add)
    padded = F.transform(runs, lambda r: F.struct(F.greatest(r["start"] - keep, F.lit(0)).alias("start"), F.least(r["end"] + keep, n).alias("end")))
    return F.when(F.size(loud) > 0, padded).otherwise(F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))))


def masked(wave: Column, spans: Column) -> Column:
    """The wave, zero outside array<struct<start, end>>."""
    return F.transform(wave, lambda x, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), x).otherwise(0.0))
