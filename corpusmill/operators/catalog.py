"""Listings and choices among files, settings with defaults, and tables of weights cut to size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
GENRES = [
    "Academic", "Anthropology", "Archaeology", "Architecture", "Art", "Astrology", "Biography", "Biology", "Business", "Chemistry", "Cinema",
    "Culinary", "Drama", "Economy", "Education", "Engineering", "Essay", "Fantasy", "Fashion", "Finance", "Health", "History", "Journalism", "Law",
    "Literature", "Medicine", "Memoir", "Metaphysic", "Music", "Mythology", "Novel", "Other", "Philosophy", "Physics", "Poetry", "Politics",
    "Psychology", "Religion", "Science", "ScienceFiction", "Sociology", "Spiritual", "Sports", "Technology", "Theology", "Travel",
]
CHECKPOINTS = ["gpt_interrupted.pth", "interrupted.pth", "gpt_latest.pth", "latest.pth"]
DEFAULT_DATASET = "google/fleurs"
ENGLISH_FROM, ENGLISH_SIZE = 10201, 1800


def preferred(files: DataFrame, by: str, name: str, order: list[str]) -> DataFrame:
    """(by, name): of each group the file that comes first in the order; groups without any are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return files.where(F.col(name).isin(order)).groupBy(by).agg(F.min_by(name, place).alias(name))


def first_existing(rows: DataFrame, key: str, candidates: list[Column], files: DataFrame, path: str, otherwise: Column) -> DataFrame:
    """rows with `resolved`: the first candidate that is among the files, else `otherwise`. Keys are distinct."""
    tries = rows.select(key, F.posexplode(F.array(*candidates)).alias("_place", path)).where(F.col(path).isNotNull())
    found = tries.join(files.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "_place").alias("_found"))
    return rows.join(found, key, "left").withColumn("resolved", F.coalesce("_found", otherwise)).drop("_found")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def mismatched(runs: DataFrame, used: str, wanted: str) -> DataFrame:
    """Runs whose tokenizer has another file name than the one asked for."""
    return runs.where(base_name(F.col(used)) != base_name(F.col(wanted)))


def with_defaults(settings: DataFrame, **defaults) -> DataFrame:
    """One row of settings: missing columns and nulls take the defaults."""
    have = set(settings.columns)
    return settings.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()})


def locales(files: DataFrame, name: str) -> DataFrame:
    """(language): of en_US.json the en, each once."""
    return files.where(F.col(name).endswith(".json")).select(F.split(name, "_")[0].alias("language")).distinct().orderBy("language")


def listed(files: DataFrame, name: str, suffix: str, none: str = "none") -> DataFrame:
    """(listing): names with the suffix, in order, a line each; `none` if there are none."""
    chosen = files.where(F.lower(F.col(name)).endswith(suffix.lower()))
    return chosen.agg(F.array_join(F.array_sort(F.collect_list(name)), "\n").alias("l")).select(F.when(F.col("l") == "", none).otherwise(F.col("l")).alias("listing"))


def datasets_of(lang: Column, catalogue: dict[str, list[str]]) -> Column:
    default = F.array(F.lit(DEFAULT_DATASET))
    if not catalogue:
        return default
    known = F.create_map(*(x for k, v in catalogue.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(known, lang), default)


def subset_of(lang: Column, codes: dict[str, str]) -> Column:
    low = F.lower(lang)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), low), low) if codes else low


def english_block(vocabulary: DataFrame, size: int) -> DataFrame:
    """The English pieces of a full vocabulary with the ids that they have in one of `size`."""
    base = size - ENGLISH_SIZE
    return vocabulary.where(F.col("id").between(ENGLISH_FROM, ENGLISH_FROM + ENGLISH_SIZE - 2)).withColumn("id", (F.col("id") - (ENGLISH_FROM - 1) + base).cast(vocabulary.schema["id"].dataType))


def resized(weights: DataFrame, size: int, vocabulary: bool = True, row: str = "row") -> DataFrame:
    """Rows of a weight table for `size` rows: a smaller vocabulary keeps its base and the English rows behind it, others what overlaps."""
    n = F.broadcast(weights.agg(F.count("*").alias("_n")))
    every = weights.crossJoin(n)
    base = size - ENGLISH_SIZE
    surgery = F.lit(vocabulary and size > ENGLISH_SIZE) & (F.col("_n") > size)
    moved = F.col(row) - ENGLISH_FROM + base
    new = F.when(~surgery, F.when(F.col(row) < size, F.array(F.col(row)))).otherwise(F.concat(F.when(F.col(row) < base, F.array(F.col(row))).otherwise(F.expr("cast(array() as array<bigint>)")), F.when(F.col(row).between(ENGLISH_FROM, ENGLISH_FROM + ENGLISH_SIZE - 1), F.array(moved)).otherwise(F.expr("cast(array() as array<bigint>)"))))
    return every.withColumn(row, F.explode(new)).drop("_n")


def discovered(files: DataFrame, project: str, name: str) -> DataFrame:
    """(project, dataset, train, val): of each project the first training manifest, and the validation manifest that goes with it."""
    train = files.where(F.col(name).endswith("_train.jsonl")).groupBy(project).agg(F.min(name).alias("train"))
    dataset = F.regexp_replace("train", "_train[.]jsonl$", "")
    return train.select(project, dataset.alias("dataset"), "train", F.concat(dataset, F.lit("_val.jsonl")).alias("val"))


def synced(settings: DataFrame, size: str, wanted: Column) -> DataFrame:
    """settings with the wanted size, and whether it had to change; without a size the default is 12,000."""
    had = F.coalesce(F.col(size), F.lit(12000))
    return settings.withColumn("changed", had != wanted).withColumn(size, wanted)


def case_of(own: Column, case: Column) -> Column:
    """The case that a tokenizer is fed with: what is asked for by one of the own kind, capitals by any other."""
    return F.when(own, F.coalesce(case, F.lit("lowercase"))).otherwise("uppercase")
