"""Audit of filters that interact: what each removes in every order, and its Shapley value, from one count of failure masks.

A document's mask is the set of filters that it fails. With x_i the probability that filter i is applied, the expected number of
removed documents of a part is a multilinear polynomial: each mask m adds its documents times 1 - prod(1 - x_i for i in m). Its
coefficient of prod(x_i for i in S) is the number of documents that fail all of S, with the sign of (-1)^(|S|+1). Its value at a
corner of the cube is what that set of filters removes, so corners give the survivors after every prefix of every order; the
integral over the diagonal of its derivative by x_i, an exact fraction, is filter i's Shapley value, and 120 times that is what the
filter removes, summed over all orders.

The filters: A under 100 words; B distinct words under 80 % of the words; C capital letters A-Z over 10 % of the code points; D any
of #$%&*|; E a text that some smaller id has too, in whatever part and removed or not. Texts are told apart by 128 bits of a digest.

Every row counts, repeated rows too; rows of one id do not make each other fail E, and a row without an id neither fails E nor makes
another fail it. Null texts are empty, null parts are the part of the empty string. A document is good, or toxic, if any of its rows
of labels says so; labels without an id, or of no document, count for nothing. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, in_slices

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS, _SIGNS, _INNER = bytes(range(0x41, 0x5B)), b"#$%&*|", bytes(range(0x80, 0xC0))
_E = 1 << FILTERS.index("E")


def own_faults(data: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    words, capitals = data.split(), len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _INNER))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * points, len(data.translate(None, _SIGNS)) < len(data))
    return sum(1 << i for i, x in enumerate(fails) if x)


def masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, a, b, mask): the bits of A to D, and the digest of the text, of every row."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            texts = byte_values(batch.column(2))
            ab = np.frombuffer(b"".join(map(xxh3_128_digest, texts)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.array(list(map(own_faults, texts)), pa.int32())], ["id", "part", "a", "b", "mask"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, part string, a long, b long, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of a mask.

    Only ids, digests and masks are dealt out, never texts. Copies of a text are counted by part before they meet: a row is left for each
    (text, part, label), with its smallest id and the rows of that id.
    """
    rows = masks(docs, id_col, text_col, part_col).groupBy("id", "part", "a", "b", "mask").agg(F.count("*").alias("n"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(rows.schema["id"].dataType).alias("id"))
    told = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    no = F.lit(False)
    known = rows.where("id is not null").join(told, "id", "left").withColumns({"good": F.coalesce("good", no), "bad": F.coalesce("bad", no)})
    every = known.unionByName(rows.where("id is null").withColumns({"good": no, "bad": no}))  # null ids never meet a label, nor in one task
    copies = every.groupBy("a", "b", "mask", "part", "good", "bad", F.col("id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min(F.col("first")["id"]).over(Window.partitionBy("a", "b"))
    late = F.when(F.col("nameless"), 0).when(F.col("first")["id"] == F.col("least"), F.col("n") - F.col("first")["n"]).otherwise(F.col("n"))
    kinds = copies.withColumn("least", least).withColumn("late", late.cast("long"))
    both = F.array(F.struct("mask", (F.col("n") - F.col("late")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(_E)).alias("mask"), F.col("late").alias("n")))
    each = kinds.select("part", "good", "bad", F.explode(both).alias("m")).select("part", "good", "bad", "m.*").where("n > 0")
    return each.groupBy("part", "mask").agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(k) for k, x in (("n", F.col("n")), ("good", F.when(F.col("good"), F.col("n"))), ("toxic", F.when(F.col("bad"), F.col("n"))))])


def removal_polynomial(counts: list[int]) -> list[int]:
    """The coefficients, by set of filters, from the documents of each mask."""
    failing = list(counts)  # becomes, by set: how many fail all of it
    for i in range(len(FILTERS)):
        for s in range(len(failing)):
            if not s >> i & 1:
                failing[s] += failing[s | 1 << i]
    return [0] + [n if s.bit_count() % 2 else -n for s, n in enumerate(failing) if s]


def at_corner(polynomial: list[int], chosen: int) -> int:
    """What the filters of a set remove together: the value where just their x are 1."""
    return sum(c for s, c in enumerate(polynomial) if s & ~chosen == 0)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The integral, t from 0 to 1, of the derivative by x_i at (t, ..., t): a term of k factors gives t^(k-1), and so 1/k."""
    return sum((Fraction(c, s.bit_count()) for s, c in enumerate(polynomial) if s >> i & 1), Fraction(0))


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(part: str, n: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of one part, from its documents of each mask: all of them, the good ones, the toxic ones."""
    whole, total, orders = removal_polynomial(n), sum(n), 120
    every, size = (1 << len(FILTERS)) - 1, range(len(FILTERS))
    removed, lost_good, lost_toxic = ([at_corner(p, s) for s in range(every + 1)] for p in (whole, removal_polynomial(good), removal_polynomial(toxic)))
    values = [orders * shapley(whole, i) for i in size]
    assert all(v.denominator == 1 for v in values)
    out = []
    for order in permutations(size):
        done = 0
        for step, i in enumerate(order, 1):
            now = done | 1 << i
            here = removed[now] - removed[done]
            out.append((part, "".join(FILTERS[j] for j in order), step, total - removed[now], here, removed[1 << i] - here, removed[every] - removed[every & ~(1 << i)], lost_good[now] - lost_good[done], lost_toxic[now] - lost_toxic[done], int(values[i])))
            done = now
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report of every part: a row for each of 120 orders and each of its five steps."""
    names = [x.split()[0] for x in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                by = [[0] * (1 << len(FILTERS)) for _ in range(3)]
                for m in row["m"]:
                    for k, name in enumerate(("n", "good", "toxic")):
                        by[k][m["mask"]] += m[name]
                columns = list(zip(*report(row["part"], *by)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k < 2 else pa.int32() if k == 2 else pa.int64()) for k, x in enumerate(columns)], names)

    parts = mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 masks at most
    return parts.mapInArrow(run, REPORT)
