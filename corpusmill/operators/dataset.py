"""Datasets of clips: metadata, resuming, manifests, splits and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_text(*candidates: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates), F.lit(""))


def metadata_line(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def read_line(line: Column) -> Column:
    """struct(lang, dataset, filename, speaker, text) of a line with five parts at least, else null; what follows a sixth mark is lost."""
    p = F.split(F.trim(line), r"\|")
    return F.when(F.size(p) >= 5, F.struct(*(F.try_element_at(p, F.lit(i + 1)).alias(n) for i, n in enumerate(("lang", "dataset", "filename", "speaker", "text")))))


def clip_name(number: Column, width: int = 6) -> Column:
    return F.format_string(f"audio_%0{width}d.wav", number)


def next_number(names: DataFrame, name: str) -> DataFrame:
    """(next): one more than the largest number in the names, 0 without any."""
    return names.agg(F.coalesce(F.max(F.expr(f"try_cast(regexp_extract({name}, 'audio_([0-9]+)[.]wav', 1) as int)")) + 1, F.lit(0)).alias("next"))


def split_position(frame: DataFrame, order: str, percent: float) -> DataFrame:
    """The first int(n * (1 - percent / 100)) rows are train, the others val. Numbers come from range partitions, not from one task."""
    from .vocab import numbered

    n = frame.agg(F.count("*").alias("_total"))
    placed = numbered(frame, F.col(order)).crossJoin(F.broadcast(n))
    edge = F.floor(F.col("_total") * (1 - percent / 100))
    return placed.withColumn("split", F.when(F.col("place") - 1 < edge, "train").otherwise("val")).drop("_total", "place")


def pad_segments(start: Column, end: Column, total: Column, by: int = 50) -> tuple[Column, Column]:
    """A margin on both sides, within the recording."""
    return F.greatest(F.lit(0), start - by), F.least(total, end + by)


def pack_segments(segments: Column, longest: Column) -> Column:
    """array<struct<start, end, text>>: neighbours are joined while they fit; a cut comes at the start of a segment."""
    kind = "array<struct<start:double,end:double,text:string>>"

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        alone = F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end"), x["text"].alias("text"))
        joined = F.struct(last["start"].alias("start"), x["end"].cast("double").alias("end"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))
        return F.when((F.size(out) > 0) & (x["end"] - last["start"] <= longest), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(alone)))

    return F.aggregate(segments, F.expr(f"cast(array() as {kind})"), add)


def split_fixed(length: Column, most: int) -> Column:
    """array<struct<start, end>> of pieces of up to `most`."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, F.lit(most).cast("long")), lambda a: F.struct(a.alias("start"), F.least(a + most, length.cast("long")).alias("end")))).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))


def concat_turns(turns: DataFrame, by: list[str], order: str, text: str, separator: str = " ") -> DataFrame:
    """The texts of a group in order, joined."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return turns.groupBy(*by).agg(listed.alias("_t"), F.count("*").alias("n_turns")).select(*by, "n_turns", F.array_join(F.transform("_t", lambda x: x[text]), separator).alias(text))


def with_language(ids: Column, language: Column) -> Column:
    """The language id in front, unless it is there or there are no ids."""
    return F.when((F.size(ids) > 0) & (F.try_element_at(ids, F.lit(1)) != language), F.concat(F.array(language), ids)).otherwise(ids)


def clamp(ids: Column, most: int) -> Column:
    return F.transform(ids, lambda i: F.greatest(F.lit(0), F.least(i, F.lit(most))))


def shifted(ids: Column, start: int, stop: int) -> tuple[Column, Column]:
    """(input, target): a start before, a stop after."""
    return F.concat(F.array(F.lit(start)), ids), F.concat(ids, F.array(F.lit(stop)))


def stop_after(ids: Column, length: Column, stop: int) -> Column:
    return F.transform(ids, lambda x, i: F.when(i < length, x).otherwise(stop))


def gaps_between(items: DataFrame, by: list[str], order: str, gap: int) -> DataFrame:
    """items with gap_ms: the silence after each but the last of its group."""
    following = F.lead(order).over(Window.partitionBy(*by).orderBy(order))
    return items.withColumn("gap_ms", F.when(following.isNotNull(), gap).otherwise(0))


def concat_waves(segments: DataFrame, by: list[str], order: str, wave: str, gap: int = 0) -> DataFrame:
    """(by, wave): the waves of a group in order, each followed by `gap` samples of silence, the last one too."""
    listed = F.array_sort(F.collect_list(F.struct(order, wave)))
    silence = F.array_repeat(F.lit(0.0), gap)
    return segments.groupBy(*by).agg(listed.alias("_w")).select(*by, F.flatten(F.transform("_w", lambda x: F.concat(x[wave], silence))).alias(wave))


def training_lines(metadata: DataFrame, corpus: DataFrame, rule, text: str = "text", order: str = "ord", distinct: bool = True) -> DataFrame:
    """(source, ord, text): lines of metadata by the rule, then chunks of the corpus as they are, without blank ones; of equal texts
    the first if they are to be distinct."""
    lines = metadata.select(F.lit(0).alias("source"), order, rule(F.col(text)).alias(text)).unionByName(corpus.select(F.lit(1).alias("source"), order, F.col(text).alias(text)))
    lines = lines.where(F.trim(text) != "")
    if not distinct:
        return lines
    return lines.groupBy(text).agg(F.min(F.struct("source", order)).alias("_first")).select("_first.source", f"_first.{order}", text)
