"""What the operators of this package share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the folder in spark.checkpoint.dir and go on from there, without its lineage.

    The folder is shared by all executors, so a lost executor costs no earlier work, and values such as row numbers stay what
    they were. Where the setting is missing, a temporary folder serves a local session, as in tests; on a cluster it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp("checkpoints"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: str | Column) -> Column:
    """128 bits that identify a row by the given columns; equal rows share a key. Nulls are told apart from every value."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    marked = [x for c in cols for x in (F.when(c.isNull(), F.lit("null")).otherwise(F.lit("")), c)]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit("b"), *reversed(marked)).alias("b"))


def let(value: Column, body) -> Column:
    """body(x), in which x stands for value, computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that no slice of several rows holds more than `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
