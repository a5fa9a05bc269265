"""Named queries with their equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for rules that cost much by row."""
    from ..operators.corpus import spread

    return spread(table(spark, sf_dir, "documents"))


def met(spark: SparkSession, sf_dir: str, items: list[str], name: str) -> DataFrame:
    """(ord, name, n): of each item in how many documents it stands, without the word mark."""
    from ..operators.corpus import spread

    listed = spark.createDataFrame(list(enumerate(items)), f"ord int, {name} string")
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x.replace("▁", "")).alias("x")) for i, x in enumerate(items)])
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    found = docs.select(F.explode(F.filter(each, lambda e: F.contains(F.col("text"), e["x"]))).alias("e")).groupBy("e.ord").agg(F.count("*").alias("n"))
    return listed.join(found, "ord", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


# Pieces of SQL that several queries share.
def met_sql(items: list[str], name: str) -> str:
    rows = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(items))
    return f"select ord, {name}, coalesce(n, 0) as n from (values {rows}) t(ord, {name}) left join (select ord, count(*) as n from documents, (values {rows}) u(ord, x) where contains(text, replace(x, '▁', '')) group by ord) using (ord)"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


def squeezed(text: str) -> str:
    return f"regexp_replace({text}, '\\s+', ' ', 'g')"


def set_apart(text: str, more: str = "") -> str:
    """Punctuation set apart without look-around: dots before dots and marks within numbers are hidden meanwhile."""
    before = f"regexp_replace({text}, '([,:])([^\\s\\d])|([()!?;{more}])(\\S)|(\\.)([^\\s\\d.])', '\\1\\3\\5 \\2\\4\\6', 'g')"
    hidden = f"array_to_string(list_transform(regexp_extract_all({before}, '\\.+|[^.]+'), lambda x: case when x[1] = '.' then repeat(chr(57344), length(x) - 1) || '.' else x end), '')"
    for _ in range(2):
        for mark, sign in ((".", 57345), (",", 57346), (":", 57347)):
            hidden = f"regexp_replace({hidden}, '(\\d)[{mark}](\\d)', '\\1' || chr({sign}) || '\\2', 'g')"
    after = f"regexp_replace({hidden}, '([^\\s])([!?;:.,(){more}])', '\\1 \\2', 'g')"
    return f"translate({after}, chr(57344) || chr(57345) || chr(57346) || chr(57347), '..,:')"


def western(text: str, more: str, keeps: str) -> str:
    return f"trim(regexp_replace({squeezed(set_apart(f'lower({text})', more))}, '[^{keeps}]', '', 'g'))"


ENGLISH = "a-zA-Z.,!?:;''()\\[\\] 0-9\\-"
SPANISH = "a-zA-ZñÑáéíóúüÁÉÍÓÚÜ.,!?:;''()\\[\\] ¿¡0-9\\-"


def normalized(text: str, lang: str) -> str:
    return f"case {lang} when 'en' then {western(text, '', ENGLISH)} when 'es' then {western(text, '¿¡', SPANISH)} else lower({stripped(squeezed(f'nfc_normalize({text})'))}) end"
