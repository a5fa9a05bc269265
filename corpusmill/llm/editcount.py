"""Edit-aware token counts.

The pre-tokens of a document stand in blocks, and over the blocks stands a tree of sums of characters and tokens. Trees are kept: a
document's row holds its text, the length and the number of tokens of every pre-token, and how many of them each block has, from
which the tree is put up again without encoding anything. An edit finds its place by descending the tree. Only the pre-tokens that
it touches and a boundary context are cut and encoded anew: from a boundary at least three characters before the edit until a new
boundary behind the edit falls on an old one, from where on all is as it was. Then the sums on the way to the root are brought up
to date, and the tree can be kept again, for the next edits.

The pattern may look two characters beyond a match at most, as those of the public rank files do, and not back; for another one
`CONTEXT` must be one more than what it looks ahead.

Null texts are empty; null or empty lists of edits change nothing. Edits apply one after another, each to the text that the one
before has left; offsets are code points, beyond the text they are its end, an end before its start is the start; null replacements
are empty. Rows are independent, repeated rows give repeated results, an empty table an empty one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks, splitter
from .common import fresh, in_slices

#: Pre-tokens in a block at first; blocks that grow to eight times as many are dealt anew.
BLOCK = 64
CONTEXT = 3
REMEMBERED = 400_000


class Counter(dict):
    """Maps a pre-token to its number of tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={w: i for i, w in enumerate(read_ranks(path))}, special_tokens={})
        self.cut = splitter(pattern)

    def __missing__(self, token: str) -> int:
        n = len(self.encoding.encode_ordinary(token))
        if len(token) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = n
        return n

    def counts(self, tokens: list[str]) -> list[int]:
        return list(map(self.__getitem__, tokens))


class Tree:
    """A document's pre-tokens and their sums. Node 1 is the root, node i stands over 2i and 2i + 1, leaves are blocks: the text of
    some pre-tokens, their lengths and their numbers of tokens."""

    def __init__(self, text: str, lengths: list[int], counts: list[int], sizes: list[int], counter: Counter):
        self.counter, self.encoded = counter, 0
        self._stand(text, lengths, counts, sizes)

    @classmethod
    def of_text(cls, text: str, counter: Counter) -> Tree:
        tokens = counter.cut(text)
        tree = cls(text, list(map(len, tokens)), counter.counts(tokens), [min(BLOCK, len(tokens) - i) for i in range(0, len(tokens), BLOCK)], counter)
        tree.encoded = len(tokens)
        return tree

    @classmethod
    def kept(cls, row: dict, counter: Counter) -> Tree:
        return cls(row["text"], *(np.frombuffer(row[k], "<u4").tolist() for k in ("lengths", "counts", "sizes")), counter)

    def keep(self) -> dict:
        """What a row holds of it."""
        every = lambda k: np.fromiter((x for b in self.blocks for x in b[k]), "<u4").tobytes()
        return {"text": "".join(b[0] for b in self.blocks), "lengths": every(1), "counts": every(2), "sizes": np.array([len(b[1]) for b in self.blocks if b[1]], "<u4").tobytes()}

    def _stand(self, text: str, lengths: list[int], counts: list[int], sizes: list[int]) -> None:
        self.blocks, at, place = [], 0, 0
        for n in sizes:
            own = lengths[at : at + n]
            end = place + sum(own)
            self.blocks.append((text[place:end], own, counts[at : at + n]))
            at, place = at + n, end
        self.width = 1 << max(len(self.blocks) - 1, 0).bit_length()
        self.blocks += [("", [], [])] * (self.width - len(self.blocks))
        self.chars = [0] * self.width + [len(b[0]) for b in self.blocks]
        self.tokens = [0] * self.width + [sum(b[2]) for b in self.blocks]
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def pre_tokens(self) -> int:
        return sum(len(b[1]) for b in self.blocks)

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds the character `at` (or the last that holds any), and where the block starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, text: str) -> None:
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, at = self.find(max(0, start - CONTEXT - 1))
        held, lengths, counts = self.blocks[first]
        # within the block, what ends early enough stays
        head, where = 0, at
        while head < len(lengths) and where + lengths[head] <= start - CONTEXT:
            where += lengths[head]
            head += 1
        before, lengths, counts = held[where - at :], lengths[head:], counts[head:]
        last, far = first, end + 64
        while True:
            while where + len(before) < far and last + 1 < self.width:
                last += 1
                more, its_lengths, its_counts = self.blocks[last]
                before, lengths, counts = before + more, lengths + its_lengths, counts + its_counts
            after = before[: start - where] + text + before[end - where :]
            grown = len(after) - len(before)
            new = self.counter.cut(after)
            if where + len(before) >= self.length:
                same, tail = len(new), len(lengths)
                break
            bounds = {b: i + 1 for i, b in enumerate(accumulate(lengths)) if where + b >= end}
            match = next(((i + 1, bounds[b - grown]) for i, b in enumerate(accumulate(map(len, new))) if where + b - grown >= end and b - grown in bounds and b <= len(after) - CONTEXT), None)
            if match:
                same, tail = match
                break
            far = where + 2 * len(before) + 64
        made = new[:same]
        self.encoded += len(made)
        kept = self.blocks[first]
        self._put(first, last, held[: where - at] + after, kept[1][:head] + list(map(len, made)) + lengths[tail:], kept[2][:head] + self.counter.counts(made) + counts[tail:])

    def _put(self, first: int, last: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Blocks first to last now hold these, in even parts."""
        n = last - first + 1
        if len(lengths) > 8 * BLOCK * n:
            front, back = self.blocks[:first], self.blocks[last + 1 :]
            whole = lambda k, x: [*(v for b in front for v in b[k]), *x, *(v for b in back for v in b[k])]
            lengths = whole(1, lengths)
            self._stand("".join([*(b[0] for b in front), text, *(b[0] for b in back)]), lengths, whole(2, counts), [min(BLOCK, len(lengths) - i) for i in range(0, len(lengths), BLOCK)])
            return
        size, place, touched = -(-len(lengths) // n), 0, set()
        for j in range(n):
            own = lengths[j * size : (j + 1) * size]
            block = (text[place : place + sum(own)], own, counts[j * size : (j + 1) * size])
            place += len(block[0])
            i = self.width + first + j
            self.blocks[first + j], self.chars[i], self.tokens[i] = block, len(block[0]), sum(block[2])
            touched.add(i // 2)
        while touched and touched != {0}:
            for i in touched:
                self._add(i)
            touched = {i // 2 for i in touched if i > 1}


@lru_cache(1)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


#: What a kept tree's row has besides its id and number of tokens.
KEPT = {"text": "string", "lengths": "binary", "counts": "binary", "sizes": "binary"}


def build(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, text, lengths, counts, sizes) of every row, and the columns in keep: the trees, to be written or updated."""
    names = [id_col, *keep]
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in in_slices(batches, "text", 4 << 20):
            lengths, counts, sizes, totals = [], [], [], []
            texts = batch.column(0).to_pylist()
            for text in texts:
                tokens = c.cut(text or "")
                of = np.fromiter(map(c.__getitem__, tokens), "<u4", len(tokens))
                lengths.append(np.fromiter(map(len, tokens), "<u4", len(tokens)).tobytes())
                counts.append(of.tobytes())
                sizes.append(np.array([min(BLOCK, len(tokens) - i) for i in range(0, len(tokens), BLOCK)], "<u4").tobytes())
                totals.append(int(of.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(totals, pa.int64()), pa.array([t or "" for t in texts], pa.string()), *(pa.array(x, pa.binary()) for x in (lengths, counts, sizes))], [*(f"_{i}" for i in range(len(names))), "n_tokens", *KEPT])

    rows = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(names)])
    made = rows.mapInArrow(run, f"{kinds}, n_tokens long, " + ", ".join(f"{k} {t}" for k, t in KEPT.items()))
    return made.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "n_tokens", *KEPT)


def update(trees: DataFrame, path: str, pattern: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """(id, n_before, n_tokens, n_pre_tokens, n_encoded_again, and the trees after the edits) of kept trees with a column of edits,
    array<struct<start, end, text>>. Nothing but what edits touch is encoded; n_pre_tokens is before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in in_slices(batches, "text", 4 << 20):
            numbers, after = [], []
            columns = {k: batch.column(3 + i).to_pylist() for i, k in enumerate(KEPT)}
            for i, (edits, before) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                row = {k: x[i] for k, x in columns.items()}
                n, after_edits, again = len(row["lengths"]) // 4, before, 0
                edits = [e for e in edits or () if e is not None and e["start"] is not None]
                if edits:
                    tree = Tree.kept(row, c)
                    for e in edits:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "")
                    row, after_edits, again = tree.keep(), tree.total, tree.encoded
                numbers.append((before, after_edits, n, again))
                after.append(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*numbers)), *(pa.array([r[k] for r in after], pa.string() if t == "string" else pa.binary()) for k, t in KEPT.items())], ["id", "n_before", "n_tokens", "n_pre_tokens", "n_encoded_again", *KEPT]
            )

    kind = trees.schema[id_col].dataType.simpleString()
    rows = trees.select(F.col(id_col).alias("id"), F.col(edits_col).cast("array<struct<start:int,end:int,text:string>>").alias("edits"), "n_tokens", *KEPT)
    made = rows.mapInArrow(run, f"id {kind}, n_before long, n_tokens long, n_pre_tokens long, n_encoded_again long, " + ", ".join(f"{k} {t}" for k, t in KEPT.items()))
    return made.withColumnRenamed("id", id_col)


def count_with_edits(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_before, n_after, n_pre_tokens, n_encoded_again) of every row; edits: array<struct<start, end, text>>."""
    out = update(build(docs, path, pattern, id_col, text_col, (edits_col,)), path, pattern, id_col, edits_col)
    return out.select(id_col, "n_before", F.col("n_tokens").alias("n_after"), "n_pre_tokens", "n_encoded_again")


def attach_edits(rows: DataFrame, edits: DataFrame, id_col: str = "doc_id", order: str = "seq", name: str = "edits") -> DataFrame:
    """rows (documents or kept trees) with the array `name` from a table (id, order, start, end, text), in place of a column of that
    name; rows without edits have none, nor have rows without an id. Edits of one id are listed in one row, as each needs the text
    that the one before has left."""
    (own,) = fresh(rows, "_edited")
    listed = edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "text"))).alias(name))
    listed = listed.withColumn(name, F.transform(name, lambda x: F.struct(x["start"], x["end"], x["text"])))
    base = rows.drop(*[c for c in rows.columns if c.lower() == name.lower()])
    return base.join(listed, base[id_col] == listed[own], "left").drop(own)
