"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of consecutive words, a window into shingles. Shingles are ordered by how often they occur in the
whole corpus. As all of a window must occur, its prefix is its single rarest shingle: only that one is looked up. Where it is
found, its place in the window gives the place of the window in the document (positional bound), which must lie inside the
document (length bound); then the words are compared one by one.

Words are runs of [0-9a-z] and characters beyond ASCII, after lower-casing A-Z. Null and empty texts have no words and are not
contaminated; empty items and null items have no windows; an item shorter than a window is one window. Repeated rows get equal
results; repeated items count once each item id, items without an id not at all. With an empty benchmark no word is hit. Extra
columns of documents are dropped. Ties between equally rare shingles go to the earlier one.

The items are taken in blocks of bounded size, each sent to the executors whole; most benchmarks are one block. With more, the
documents are read once for each block and the hit spans of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, fresh, in_slices, settle

WINDOW, SHINGLE = 13, 5
#: Bytes of benchmark text in a block, the bound of what is sent to executors.
BLOCK_BYTES = 8 << 20
_TO_WORDS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


def shingle_codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of each k consecutive ids."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    code = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        code = (code ^ x[i : i + len(code)]) * _MIX
        code ^= code >> np.uint64(29)
    return code


class Index:
    """The windows of a block of items. Word ids are exact, from 1; 0 is a word of no item."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, shingle: int):
        self.word_ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = tuple(self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[i : i + window], set()).add(item)
        self.windows, self.items = list(found), [sorted(x, key=str) for x in found.values()]
        self.shingle = shingle
        #: by shingle length, the distinct codes in order
        self.codes = {k: np.unique(np.concatenate([shingle_codes(np.array(w), k) for w in self.windows if min(shingle, len(w)) == k])) for k in {min(shingle, len(w)) for w in self.windows}}
        self.prefix: dict[int, tuple[np.ndarray, list]] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.word_ids.get
        return np.fromiter([get(w, 0) for w in words], np.int64, len(words))

    def occurrences(self, ids: np.ndarray, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ids of the given codes, and which code it is."""
        at = np.flatnonzero(ids)
        if k > 1 and len(at):  # all words of a shingle are known
            known = np.concatenate([ids != 0, np.zeros(k, bool)])
            run = known[: len(ids)].copy()
            for i in range(1, k):
                run &= known[i : i + len(ids)]
            at = np.flatnonzero(run)
        if not len(at) or not len(codes):
            return at[:0], at[:0]
        code = np.zeros(len(at), np.uint64)
        for i in range(k):
            code = (code ^ ids[at + i].astype(np.uint64)) * _MIX
            code ^= code >> np.uint64(29)
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        same = codes[place] == code
        return at[same], place[same]

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle; counts are of self.codes."""
        self.prefix = {}
        for k, codes in self.codes.items():
            by_code: dict[int, list] = {}
            for n, w in enumerate(self.windows):
                if min(self.shingle, len(w)) == k:
                    place = np.searchsorted(codes, shingle_codes(np.array(w), k))
                    offset = int(np.argmin(counts[k][place]))
                    by_code.setdefault(int(place[offset]), []).append((n, offset))
            chosen = np.array(sorted(by_code), np.int64)
            self.prefix[k] = (codes[chosen], [by_code[int(c)] for c in chosen])
        self.arrays = [np.array(w, np.int64) for w in self.windows]

    def find(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(start, window) of every occurrence within a document; bounds are the starts of documents and the end."""
        out = []
        for k, (codes, uses) in self.prefix.items():
            at, which = self.occurrences(ids, k, codes)
            doc = np.searchsorted(bounds, at, "right") - 1
            for p, c, lo, hi in zip(at.tolist(), which.tolist(), bounds[doc].tolist(), bounds[doc + 1].tolist()):
                for n, offset in uses[c]:
                    start, w = p - offset, self.arrays[n]
                    if lo <= start and start + len(w) <= hi and np.array_equal(ids[start : start + len(w)], w):
                        out.append((start, n))
        return out


def _texts(batches: Iterator[pa.RecordBatch], index: Index):
    for batch in in_slices(batches, "text"):
        words = [words_of(t) for t in byte_values(batch.column(batch.schema.get_field_index("text")))]
        bounds = np.cumsum([0, *map(len, words)])
        yield batch, bounds, index.ids([w for x in words for w in x])


def shingle_counts(docs: DataFrame, index: Index, text_col: str) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents (across the seam of two documents too, which changes an order at most)."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(index)

    def run(batches):
        index = sent.value
        total = {k: np.zeros(len(c), np.int64) for k, c in index.codes.items()}
        for _, _, ids in _texts(batches, index):
            for k, codes in index.codes.items():
                total[k] += np.bincount(index.occurrences(ids, k, codes)[1], minlength=len(codes))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(len(c), np.int64) for k, c in index.codes.items()}
    for k, at, n in zip(*(rows.column(c).to_pylist() for c in ("k", "at", "n"))):
        out[k][at] = n
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of about block_bytes, dealt by a hash of the item."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for i in range(n):
        yield [(r.item, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).collect()]


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id, n_words, hits (start and end of merged runs of hit words), items (ids whose windows occur, in order as strings), and the columns in keep."""
    cols = list(dict.fromkeys([id_col, text_col, *keep]))
    source = docs.select(*cols)
    kept = T.StructType([f for f in source.schema if f.name in keep or f.name == id_col])
    names = [f.name for f in kept]
    found = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))])
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(source, first, text_col, names, found, window, shingle)
    # a row's blocks meet again by its number, which must not change between them
    (number,) = fresh(source, "_row")
    source = settle(source.withColumn(number, F.monotonically_increasing_id()))
    numbered = T.StructType([source.schema[number], *found])
    every = None
    for items in chain([first, second], blocks):
        part = _pass(source, items, text_col, [number, *names], numbered, window, shingle)
        every = part if every is None else every.unionByName(part)
    grouped = every.groupBy(number).agg(
        *[F.any_value(n).alias(n) for n in names],
        F.any_value("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # runs that touch or overlap become one
    merged = F.aggregate(
        "hits",
        F.expr("cast(array() as array<array<int>>)"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(F.element_at(out, -1), 2) >= x[0]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(F.element_at(out, -1)[0], F.greatest(F.element_at(out, -1)[1], x[1]))))).otherwise(F.concat(out, F.array(x))),
    )
    return grouped.withColumn("hits", merged).drop(number)


def _pass(source: DataFrame, items: list, text_col: str, names: list[str], found: T.StructType, window: int, shingle: int) -> DataFrame:
    """One block of items against all rows."""
    index = Index(items, window, shingle)
    index.order(shingle_counts(source, index, text_col))
    sent = source.sparkSession.sparkContext.broadcast(index)
    cols = source.columns

    def run(batches):
        index = sent.value
        for batch in batches:
            for part, bounds, ids in _texts(iter([batch.rename_columns(["text" if n == text_col else f"_{n}" for n in cols])]), index):
                hit = np.zeros(len(ids) + 1, bool)
                per: dict[int, set] = {}
                for start, n in index.find(ids, bounds):
                    hit[start : start + len(index.windows[n])] = True
                    per.setdefault(int(np.searchsorted(bounds, start, "right") - 1), set()).update(index.items[n])
                runs, all_items = [], []
                for i in range(part.num_rows):
                    own = hit[bounds[i] : bounds[i + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2) if own.any() else ()
                    runs.append([[int(a), int(b)] for a, b in edges])
                    all_items.append(sorted(map(str, per.get(i, ()))))
                columns = [part.column(cols.index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(runs, pa.list_(pa.list_(pa.int32()))), pa.array(all_items, pa.list_(pa.string()))], found.names)

    return source.mapInArrow(run, found)


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.05, **options) -> DataFrame:
    """find_windows with n_hit, n_items and contaminated: words are hit, and they are `least` of all or more, as the decimal number that
    it is written as."""
    out = find_windows(docs, benchmark, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    out = out.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
    share = Fraction(str(least))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share.denominator >= F.col("n_words") * share.numerator))
