"""Substring dedup by hashing lines and runs of sentences.

The units of a text are its lines, and from every sentence on the shortest run of sentences with `least_words` words or
`least_bytes` bytes or more (a sentence ends after . ! or ? before white space, and at the end of a line; runs go on over lines; bytes
are what counts in scripts without spaces). A long sentence is a unit by itself, and of a passage that stands in the middle of a line
all is covered but a short end. Shorter lines are no units, as they repeat by chance. A unit is normalised: A-Z lower-cased, white space between words made one space. 128-bit digests are
grouped over the whole corpus, and the occurrence of the smallest (id, offset) is kept; every other one is cut out, but for what
it shares with the kept one in the same text. Offsets in the original (code points, end exclusive) are kept beside the text.

Null texts have no units and stay null. Rows with a null id rank last. Repeated rows, having one id and the same offsets, hold the
same occurrence: all keep it. An empty table gives an empty one; other columns are dropped unless asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_slices, settle

#: Of a unit's normalised text, one or the other is needed.
LEAST_WORDS, LEAST_BYTES = 8, 48
_SENTENCE_END = re.compile(r"[.!?]+[ \t\x0b\x0c\r]+")
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def units(text: str, least_words: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised) of every unit."""
    sentences, at = [], 0
    for line in text.split("\n"):
        cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
        parts = [(at + a, at + b, words) for a, b in zip(cuts, cuts[1:]) if (words := line[a:b].encode().translate(_LOWER).split())]
        if len(parts) > 1:
            whole = b" ".join(w for _, _, p in parts for w in p)
            if len(whole) >= least_bytes or sum(len(w) for _, _, w in parts) >= least_words:
                yield at, at + len(line), whole
        sentences += [(a, b, len(w), b" ".join(w)) for a, b, w in parts]
        at += len(line) + 1
    for i, (start, end, words, said) in enumerate(sentences):
        j = i + 1
        while words < least_words and len(said) < least_bytes and j < len(sentences):
            _, end, more, then = sentences[j]
            words, said, j = words + more, said + b" " + then, j + 1
        if words >= least_words or len(said) >= least_bytes:
            yield start, end, said


def find_units(docs: DataFrame, least_words: int, least_bytes: int) -> DataFrame:
    """(id, k, high, low, start, end) of the units of (id, k, text); high and low are the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        for batch in in_slices(batches, "text", 4 << 20):
            row, start, end, digest = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for a, b, x in units(text or "", least_words, least_bytes):
                    row.append(i)
                    start.append(a)
                    end.append(b)
                    digest.append(xxh3_128_digest(x))
            two = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "k", "high", "low", "start", "end"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "k", "text").mapInArrow(run, f"id {kind}, k long, high long, low long, start int, end int")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id, the columns in keep, the text without repeats, and `removed`: array<struct<start, end>> in order.

    Digests are counted with a partial count before they are dealt out. Only those of several occurrences go on, so what meets
    the texts again is the repeats alone; a digest of many occurrences is joined to its one smallest, which joins can split.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    found = find_units(rows, least_words, least_bytes)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("start").alias("start"), F.col("end").alias("end"))
    first = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("latest")).where("first <> latest").drop("latest")
    first = settle(first)  # else the join would keep to the aggregate's dealing, whose large partitions can't be split
    later = found.join(first, ["high", "low"]).where(~place.eqNullSafe(F.col("first")))
    start = F.when(F.col("first.id").eqNullSafe(F.col("id")), F.greatest("start", F.least("first.end", "end"))).otherwise(F.col("start"))
    later = later.select("id", "k", start.alias("start"), "end").where("start < end")
    cut = later.groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    k, cut_id = fresh(docs, "_k", "_cut_id")
    base = docs.select(*dict.fromkeys([id_col, text_col, *keep])).withColumn(k, F.xxhash64(id_col, text_col))
    cut = cut.withColumnRenamed("id", cut_id)
    joined = base.join(cut, (base[id_col].eqNullSafe(cut[cut_id])) & (base[k] == cut["k"]), "left").select(*base.columns[:-1], "removed")
    at, n = base.columns.index(text_col), len(base.columns) - 1
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                if spans and text is not None:
                    kept, last = [], 0
                    for s in spans:
                        kept.append(text[last : max(last, s["start"])])
                        last = max(last, s["end"])
                    text = "".join(kept) + text[last:]
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = joined.withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    return joined.mapInArrow(run, T.StructType(joined.schema.fields))
