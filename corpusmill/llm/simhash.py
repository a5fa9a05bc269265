"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 3 differ in at most 1 bit of one of their 32-bit halves. In each half the
anchors are the words of a covering code: the perfect Hamming code of length 31 and radius 1, with the last bit free. A half's
home is its nearest anchor. A fingerprint goes to every anchor within covering radius plus threshold of its half, so a partner
within one bit of a half meets it at the partner's home; there the whole fingerprints are compared. One in 17 copies is at home,
an anchor serves 32 of the 2^32 halves, and equal fingerprints are one row throughout.

Documents of a fingerprint, and fingerprints that are linked directly or through others, are one component. Null and empty texts
have the fingerprint zero, which links like any other; repeated rows share a fingerprint; rows without an id have no part in
finding the smallest id, and a component of such rows only has none. An empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, in_slices, settle

SHINGLE, SEED, BITS = 3, 42, 3
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(data: bytes, k: int, seed: int) -> list[int]:
    """XXH64 of each k space-joined words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = data.translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-k].tolist()]
    return [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def majority(hashes: list[int]) -> int:
    """A bit is 1 if set in over half the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(most).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, f): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            f = np.array([majority(shingle_hashes(t, shingle, seed)) for t in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["id", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, f long").withColumnRenamed("id", id_col)


def _at_anchors(n: np.ndarray, home_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors (below 2^33, the half in the top bit) of 64-bit fingerprints."""
    # Position i of 1..31 is bit i; the syndrome of a word is the XOR of the positions of its set bits, and names the bit to flip.
    rows, anchors = [], []
    for half in (0, 1):
        x = (n >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(x), np.uint64)
        for i in range(1, 32):
            syndrome ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i)
        # bit 0 is the free one: flipping "position 0" is no flip, as it must be for a code word
        home = np.where(syndrome == 0, x, x ^ (np.uint64(1) << syndrome))
        made = [home]
        if not home_only:
            made.append(home ^ np.uint64(1))  # the free bit differs
            for i in range(1, 32):  # after a flip of bit i the syndrome is s ^ i, and the word decodes anew
                s, y = syndrome ^ np.uint64(i), x ^ np.uint64(1 << i)
                moved = np.where(s == 0, y, y ^ (np.uint64(1) << s))
                first = (moved != home) & ((s > i) | (s == 0))  # bits i and s lead to one code word
                rows.append(np.flatnonzero(first))
                anchors.append((moved[first] | np.uint64(half << 32)).astype(np.int64))
        for m in made:
            rows.append(np.arange(len(x)))
            anchors.append((m | np.uint64(half << 32)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(anchors)


def at_anchors(prints: DataFrame, home_only: bool) -> DataFrame:
    """(anchor, f) of each fingerprint f: its homes, or every anchor within radius plus threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            rows, anchors = _at_anchors(f.view(np.uint64), home_only)
            for i in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(anchors[i : i + 100_000]), pa.array(f[rows[i : i + 100_000]])], ["anchor", "f"])

    return prints.mapInArrow(run, "anchor long, f long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: distinct fingerprints of the one column f that differ in at most `bits` (3 or fewer) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover up to 3 differing bits")
    home = at_anchors(prints, True).withColumnRenamed("f", "a")
    near = at_anchors(prints, False).withColumnRenamed("f", "b")
    return home.join(near.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b").distinct()


def contracted(edges: DataFrame, most: int = 1 << 17) -> DataFrame:
    """(hi, lo) of the same components: the edges that a task holds at a time are joined to stars around their least node. A task holds
    `most` nodes at a time at most, so an edge list of any size goes through."""
    kind = edges.schema["hi"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            top = x
            while (up := above.get(top, top)) != top:
                top = up
            while x != top:
                above[x], x = top, above[x]
            return top

        def stars() -> Iterator[pa.RecordBatch]:
            rows = [(x, root(x)) for x in above]
            above.clear()
            for i in range(0, len(rows), 50_000):
                hi, lo = zip(*rows[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(hi, batch.column(0).type), pa.array(lo, batch.column(1).type)], ["hi", "lo"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
                if len(above) >= most:
                    yield from stars()
        if above:
            yield from stars()

    return edges.select("hi", "lo").mapInArrow(run, f"hi {kind}, lo {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached, for every node of the edges (a, b).

    Large-star and small-star rounds by turns: each round, a node's neighbours are joined to the least of them, so paths shorten
    by more than half; edges never become more than there were. Every task first joins what edges it holds to stars, so a few rounds
    do. Ends when no edge changes. Joins sort and merge, whatever the size: a broadcast would pass through the driver, round by round.
    """
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    edges = settle(contracted(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")).distinct())
    now = state(edges)
    while now[0]:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("to"))
        large = both.join(least.hint("merge"), "n").where("m > n").select(F.col("m").alias("hi"), F.col("to").alias("lo")).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("to"))
        small = large.join(down.hint("merge"), "hi").select(F.explode(F.array(F.struct("hi", F.col("to").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("to").alias("lo")))).alias("e")).select("e.*").where("hi <> lo")
        edges, before = settle(contracted(small).distinct()), now
        now = state(edges)
        if now == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, f, component_id) of every row of docs."""
    of_docs = settle(fingerprints(docs, id_col, text_col, shingle, seed))
    prints = of_docs.groupBy("f").agg(F.min(id_col).alias("least"))
    found = components(links(prints.select("f"), bits))
    rooted = prints.join(found.hint("merge"), prints.f == found.node, "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least.hint("merge"), "root").select("f", "component_id")
    return of_docs.join(classes.hint("merge"), "f").select(id_col, "f", "component_id")
