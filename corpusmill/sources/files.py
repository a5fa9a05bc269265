"""Reading and writing the file formats of a corpus. Paths may be of any store that Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import is_pdf
from ..operators.dataset import read_line

MANIFEST = "id string, audio_path string, text string, speaker string, language string, duration double, text_ids_path string, codes_path string, condition_path string, emo_vec_path string, text_len int, code_len int, condition_len int"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_pdfs(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """(name, length, content) of the files that begin as PDFs do and aren't done yet (name)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)  # others are not opened
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content").where(F.lower("name").endswith(".pdf") & is_pdf(F.col("content")))
    return found if done is None else found.join(done.select("name"), "name", "left_anti")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(lang, dataset, filename, speaker, text) of lines with five parts at least."""
    lines = spark.read.text(path).select(read_line(F.col("value")).alias("p"))
    return lines.where("p IS NOT NULL").select("p.*")


def write_metadata(clips: DataFrame, path: str, mode: str = "append") -> None:
    """A line for each clip. Marks and line ends within a part become spaces and nulls are empty, so that a line stays one line of five parts."""
    part = lambda c: F.trim(F.translate(F.coalesce(F.col(c), F.lit("")), "|\n\r", "   "))
    clips.select(F.concat_ws("|", *map(part, ("lang", "dataset", "filename", "speaker", "text"))).alias("value")).write.mode(mode).text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and broken ones are left out, a byte-order mark is no part of the first."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    return lines.select(F.from_json("line", MANIFEST).alias("m")).where("m.id IS NOT NULL").select("m.*")


def write_manifest(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def read_abbreviations(spark: SparkSession, path: str) -> dict[str, str]:
    """short=long or short:long, one a line; blank lines and comments are skipped."""
    line = F.trim("value")
    parts = F.when(F.contains(line, F.lit("=")), F.split(line, "=", 2)).when(F.contains(line, F.lit(":")), F.split(line, ":", 2))
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.trim(parts[0]).alias("a"), F.trim(F.try_element_at(parts, F.lit(2))).alias("b"))
    return {r.a: r.b for r in rows.where("a <> '' AND b <> ''").collect()}  # a rule file


def write_vocabulary(pieces: DataFrame, path: str) -> None:
    """piece TAB score, by id."""
    pieces.orderBy("id").select(F.concat_ws("\t", "piece", F.col("score").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_config(spark: SparkSession, path: str, **values) -> None:
    spark.createDataFrame([values]).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def lexicon(spark: SparkSession, groups: list[list[str]], times: int = 1) -> DataFrame:
    """(line): the distinct words of the groups in order, each `times` times, joined by spaces."""
    if times < 1:
        raise ValueError("times must be at least 1")
    words = spark.createDataFrame([(w,) for g in groups for w in g], "word string").distinct()
    listed = words.agg(F.array_sort(F.collect_list("word")).alias("w"))
    return listed.select(F.array_join(F.flatten(F.transform("w", lambda x: F.array_repeat(x, times))), " ").alias("line"))


def lexicon_lines(words: DataFrame, word: str, times: int = 1, seed: int = 0, size: int = 1000) -> DataFrame:
    """(no, line): the distinct words, each `times` times, in an order shuffled by a seeded digest, `size` of them to a line. Lines are cut
    from ranges of the order, so no task holds more than its own."""
    from ..operators.vocab import numbered

    if times < 1:
        raise ValueError("times must be at least 1")
    each = words.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct().withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "time", "word"))
    placed = numbered(each.withColumn("d", order), F.col("d"), F.col("word"), F.col("time"), name="at").withColumn("no", F.floor((F.col("at") - 1) / size))
    return placed.groupBy("no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("line"))


def read_dataset(spark: SparkSession, root: str, dataset: str, lang: str) -> DataFrame:
    """A dataset by language: the folder of the language, else that of the converted branch, else the dataset as a whole."""
    tries = [f"{root}/{dataset}/{lang}", f"{root}/{dataset}/refs/convert/parquet/{lang}", f"{root}/{dataset}", f"{root}/{dataset}.parquet"]
    for path in tries:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(f"no dataset {dataset} for {lang} in {root}")


def write_map(spark: SparkSession, path: str, values: dict[str, int]) -> None:
    """A vocabulary of tokens and ids as one JSON object."""
    spark.createDataFrame([(values,)], "m map<string,int>").select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id) of what write_map wrote."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,int>")).alias("piece", "id"))


def read_samples(rows: DataFrame, column: str, kind: str = "array<float>") -> DataFrame:
    """rows with a column of JSON arrays read as `kind`; what can't be read is null."""
    return rows.withColumn(column, F.from_json(column, kind))
