"""Long recordings, as rows of blocks: levels of frames, what lies between silences, and masks. No task holds more than a few blocks.

A recording is (rec, block, samples): blocks of `size` samples each, numbered from 0, the last one shorter or not. Frames that begin in a
block take what they lack from the blocks behind it. Runs of loud frames are found within blocks; only the first and the last one of a block
may go on in another, so these two rows of each block are put in order to join them. Recordings without a block, and null samples, are
silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .corpus import once


def in_blocks(frame: DataFrame, rec: str, at: str, value: str, size: int, name: str = "samples") -> DataFrame:
    """(rec, block, samples) of rows (rec, at, value), at from 0 without gaps."""
    rows = frame.groupBy(rec, F.floor(F.col(at) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v")))).alias("_v"))
    return rows.select(rec, "block", F.transform("_v", lambda x: x["v"]).alias(name))


def cut_blocks(frame: DataFrame, rec: str, values: str, size: int, name: str = "samples") -> DataFrame:
    """(rec, block, samples) of rows (rec, values) that hold a recording each as an array: cut where they lie, nothing is dealt out."""
    rows = frame.select(rec, once(F.col(values).cast("array<double>")).alias("_v")).where(F.size("_v") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / size).cast("int")), lambda i: F.slice("_v", i * size + 1, F.lit(size)))
    # outer, though no array is empty, as a condition on its size would cut twice
    return rows.select(rec, F.posexplode_outer(cut).alias("block", name)).withColumn("block", F.col("block").cast("long"))


def levels(blocks: DataFrame, rec: str, size: int, length: int, hop: int) -> DataFrame:
    """(rec, block, first, levels): the root of the mean square of every whole frame that begins in a block, the first of which is frame
    number `first`. Frames of `length` samples begin every `hop` samples."""
    back = -(-(length - 1) // size)
    kind, none = blocks.schema[rec].dataType.simpleString(), F.array().cast("array<double>")
    # what a frame reaches of the blocks behind: length - 1 samples at most
    whole = blocks.select(rec, "block", "samples").withColumn("rest", F.lit(None).cast("array<array<double>>"))
    if back:
        to = F.explode(F.sequence(F.greatest(F.col("block") - back, F.lit(0)), F.col("block") - 1))
        reached = blocks.where("block > 0").select(rec, "block", "samples").withColumn("to", to)
        lacks = F.greatest(length - 1 - (F.col("block") - F.col("to") - 1) * size, F.lit(0)).cast("int")
        part = F.struct(F.col("block").alias("of"), F.slice(F.coalesce("samples", none), F.lit(1), lacks).alias("samples"))
        rest = reached.select(rec, F.col("to").alias("block"), part.alias("part")).groupBy(rec, "block").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["samples"]).alias("rest"))
        whole = blocks.select(rec, "block", "samples").join(rest, [rec, "block"], "left")
    bare = whole.select(rec, "block", F.concat(F.coalesce("samples", none), F.coalesce(F.flatten("rest"), none)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, held = np.asarray(batch.column(1)), np.asarray(batch.column(2).value_lengths(), dtype=np.int64)
            x = np.asarray(batch.column(2).flatten().fill_null(0.0), dtype=float)
            first = -(-block * size // hop)
            n = np.maximum(-(-(np.minimum((block + 1) * size, block * size + held - length + 1) - first * hop) // hop), 0)
            ends, at = np.cumsum(n), np.cumsum(held) - held + first * hop - block * size  # of a block's first frame
            begins = np.repeat(at - hop * (ends - n), n) + hop * np.arange(n.sum())
            out, step = np.zeros(len(begins)), max(1, (1 << 20) // length)
            for i in range(0, len(begins), step):
                windows = np.lib.stride_tricks.sliding_window_view(x, length)[begins[i : i + step]]
                out[i : i + step] = np.sqrt((windows * windows).mean(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first), lists], [rec, "block", "first", "levels"])

    return bare.mapInArrow(run, f"`{rec}` {kind}, block long, first long, levels array<double>")


def _runs(blocks: DataFrame, rec: str, silent: float, least: int) -> DataFrame:
    """(rec, start, stop, edge, n): runs of frames over `silent` within a block, gaps of fewer than `least` frames left out, and where the
    block's frames end, null if it has none. A block without a run is a row that only has n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held = np.asarray(batch.column(1)), np.asarray(batch.column(2).value_lengths(), dtype=np.int64)
            loud = np.flatnonzero(np.asarray(batch.column(2).flatten(), dtype=float) > silent)
            of = np.repeat(np.arange(len(held)), held)[loud]
            place = loud + (first - np.cumsum(held) + held)[of]
            new = (np.diff(of, prepend=-1) != 0) | (np.diff(place, prepend=0) - 1 >= least)
            last = np.append(new[1:], True)[: len(new)]
            at = of[new]
            edge = (np.diff(at, prepend=-1) != 0) | (np.diff(at, append=-1) != 0)
            bare = np.setdiff1d(np.arange(len(held)), at)
            blank = np.arange(len(at) + len(bare)) >= len(at)
            column = lambda values: pa.array(np.append(values, np.zeros(len(bare), values.dtype)), mask=blank)
            rows = np.append(at, bare)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), column(place[new]), column(place[last] + 1), column(edge), pa.array((first + held)[rows], mask=held[rows] == 0)], [rec, "start", "stop", "edge", "n"])

    return blocks.select(rec, "first", "levels").mapInArrow(run, f"`{rec}` {blocks.schema[rec].dataType.simpleString()}, start long, stop long, edge boolean, n long")


def voiced(blocks: DataFrame, rec: str, silent: float, least: int, keep: int) -> DataFrame:
    """(rec, start, stop) in frames: what lies between silences of `least` frames or more, with `keep` frames of them on both sides; the
    whole recording if nothing is loud. blocks: (rec, block, first, levels), read once."""
    runs = settled(_runs(blocks, rec, silent, least))
    order = Window.partitionBy(rec).orderBy("start")
    edges = runs.where("edge").withColumn("gap", F.col("start") - F.lag("stop").over(order))  # two rows a block at most
    chains = edges.withColumn("chain", F.sum(F.when(F.col("gap") < least, 0).otherwise(1)).over(order)).groupBy(rec, "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    found = chains.select(rec, "start", "stop").unionByName(runs.where("NOT edge").select(rec, "start", "stop"))
    ends = runs.groupBy(rec).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    padded = ends.join(found.withColumn("loud", F.lit(True)), rec, "left")
    return padded.select(rec, F.when(F.col("loud"), F.greatest(F.col("start") - keep, F.lit(0))).otherwise(0).alias("start"), F.when(F.col("loud"), F.least(F.col("stop") + keep, "n")).otherwise(F.col("n")).alias("stop"))


def masked(blocks: DataFrame, spans: DataFrame, rec: str, size: int) -> DataFrame:
    """(rec, block, samples): zero outside of spans (rec, start, stop) of samples. Spans go to the blocks that they touch, as the places where
    they begin and end: as many for a block as it has samples, however many spans there are."""
    touched = spans.where("start < stop AND stop > 0").select(rec, F.greatest("start", F.lit(0)).alias("start"), "stop")
    touched = touched.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    local = F.array(F.struct(F.greatest(F.col("start") - F.col("block") * size, F.lit(0)).alias("at"), F.lit(1).alias("n")), F.struct(F.least(F.col("stop") - F.col("block") * size, F.lit(size)).alias("at"), F.lit(-1).alias("n")))
    events = touched.select(rec, "block", F.explode(local).alias("e")).groupBy(rec, "block", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n")).where("n <> 0")
    held = events.groupBy(rec, "block").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, at, n in zip(batch.column(2), batch.column(3), batch.column(4)):
                x = np.nan_to_num(np.asarray(x.values, dtype=float)) if x.is_valid else np.zeros(0)
                change = np.zeros(max(len(x), size) + 1)
                if at.is_valid:
                    change[np.asarray(at.values)] = np.asarray(n.values)
                out.append(np.where(change.cumsum()[: len(x)] > 0, x, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], [rec, "block", "samples"])

    joined = blocks.select(rec, "block", "samples").join(held, [rec, "block"], "left")
    return joined.mapInArrow(run, f"`{rec}` {blocks.schema[rec].dataType.simpleString()}, block long, samples array<double>")
