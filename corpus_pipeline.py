"""A pipeline over documents: reject the toxic, keep one of each near-duplicate group, take out contaminated documents, redact
secrets, and encode what is left. Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and reread as the
next one's docs; all but the last return the columns of documents, with n_chars brought up to date where a text has changed.

Rows are handled as the operators state: null texts are empty, repeated rows are near duplicates of each other, so one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontam, ordinal, secrets, simhash
from corpusmill.llm.common import fresh, row_key, settle, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    return ordinal.rate(docs, table(spark, sf_dir, "labels")).where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the smallest doc_id; of repeated rows, one. Components without any doc_id keep one row."""
    high, low, n = fresh(docs, "_high", "_low", "_n")
    key = row_key("doc_id", "text")
    keyed = docs.withColumns({high: key["a"], low: key["b"]})
    of_row = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col(high).alias("a"), F.col(low).alias("b"))
    classes = simhash.near_duplicates(keyed.select(of_row.alias("_id"), "text"), "_id", "text")
    kept = classes.where(F.col("_id") == F.col("component_id")).select(F.col("_id")["a"].alias(high), F.col("_id")["b"].alias(low)).distinct()
    # repeated rows go first, so that texts are dealt out by key once, for this and for the join (of two numbers: a struct would be
    # cast, and dealt out anew, for what may be null in it)
    single = keyed.withColumn(n, F.row_number().over(Window.partitionBy(high, low).orderBy(high))).where(F.col(n) == 1)
    return single.join(kept.hint("merge"), [high, low], "left_semi").select(*docs.columns)  # not broadcast: a key for each row kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    out = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported secret replaced by a mark."""
    out = secrets.scan(docs, docs.columns)
    text = secrets.redact(F.col("text"), F.col("spans"))
    changed = F.size("spans") > 0
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and whether decoding gives the text back; with the ids themselves."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scans), ("encoding", encoding)]
#: The stages hash, fit and encode in ways that SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, which stays in its own folder of spark.checkpoint.dir, as what is returned reads it; those of the
    others go when the next one is written, and all go when a stage fails."""
    docs = table(spark, sf_dir, "documents")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        settle(spark.range(1))  # sets a folder
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    where = f"{base}/corpus_pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
            if k:
                _delete(spark, f"{where}/{k - 1}")
    except BaseException:
        _delete(spark, where)
        raise
    return docs
