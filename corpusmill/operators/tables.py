"""Tables of a corpus in the session's catalogue: made where they are missing, written, emptied, dropped, and set back by stage."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a corpus, with their columns.
SCHEMAS = {
    "processed_documents": "id bigint, name string, lang string",
    "chunks": "doc_id bigint, page_number int, chunk_no int, lang string, text string, is_normalized boolean",
    "normalized_chunks": "lang string, text string, occurrence_count bigint, is_syllabified boolean, is_wordified boolean",
    "words": "lang string, word string, frequency bigint, is_syllabified boolean",
    "syllables": "lang string, syllable string, frequency bigint",
}
#: The flags of stages, by table.
FLAGS = {"chunks": ["is_normalized"], "normalized_chunks": ["is_syllabified", "is_wordified"], "words": ["is_syllabified"]}


def create_if_absent(spark: SparkSession, name: str, columns: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def create_corpus(spark: SparkSession, database: str, folder: str | None = None) -> None:
    """The database, in a folder of its own if one is given, with every table of a corpus; what is there already stays."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{folder}'" if folder else ""))
    for name, columns in SCHEMAS.items():
        create_if_absent(spark, f"{database}.{name}", columns)


def write(rows: DataFrame, name: str) -> bool:
    """Appends rows by the names of their columns; false, with the reason logged, if that fails."""
    try:
        rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name)
    except PySparkException as e:
        logging.getLogger(__name__).error("nothing written to %s: %s", name, e)
        return False
    return True


def truncate(spark: SparkSession, name: str) -> bool:
    """Empties a table; false if there is none."""
    if not spark.catalog.tableExists(name):
        return False
    spark.sql(f"TRUNCATE TABLE {name}")
    return True


def drop_corpus(spark: SparkSession, database: str) -> bool:
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    return True


def update_where(frame: DataFrame, condition: Column, **changes: Column) -> DataFrame:
    return frame.withColumns({name: F.when(condition, value).otherwise(F.col(name)) for name, value in changes.items()})


def reset_flags(frame: DataFrame, *flags: str) -> DataFrame:
    """All rows of the stages that the flags stand for are to do again; nothing else changes."""
    return update_where(frame, F.lit(True), **{f: F.lit(False) for f in flags})
