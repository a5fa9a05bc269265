"""Byte-pair merges at a real size: trained in rounds that settle many merges each, applied by rank.

Words stay where they are, as strings with one character for each symbol, so that a merge is a replacement in many words at once. A round proposes the most frequent pairs, which may share symbols. A task cuts every word between
the neighbours that are not proposed; what is left together is a unit, a chain if it holds more than one symbol. Proposed merges
act within chains only, so how often each chain occurs, and how often units stand side by side, gives every count after any of the
proposed merges in any order. The driver plays these merges on the distinct chains: it holds the counts of a bounded number of pairs, the most
frequent ones, and takes the most frequent pair as long as that was proposed and has no symbol made in the round, which is just what
one merge at a time would take. Merges that were taken are applied on the fly, and to the stored words every few rounds.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Pairs proposed in a round at most, their share of all neighbours (more would make chains of whole words), and rounds between two times
#: that words are stored anew.
PROPOSED, SHARE, KEPT_FOR = 512, 0.2, 3
#: Rows of chains and neighbours that the driver takes in a round, and symbols of a chain. Where there are more, fewer pairs are proposed.
ROWS, LONG = 1 << 18, 256
#: Pairs whose counts the driver holds. Where a rarer one may be next, all pairs are counted again.
HELD = 1 << 16

#: Words that a task works on at once.
TOGETHER = 1 << 17

Pair = tuple[str, str]


def symbols(word: Column, mark: str) -> Column:
    """The mark and the characters of a word."""
    return F.filter(F.split(F.concat(F.lit(mark), word), ""), lambda x: x != "")


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): how often neighbours occur in words (symbols, frequency), by the words' frequency."""
    rest = F.greatest(F.size("symbols") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("symbols", 1, rest), F.slice("symbols", 2, rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "frequency").groupBy("p.a", "p.b").agg(F.sum("frequency").cast("long").alias("n"))


def by_pair(merges: list[Pair], start: int = 0) -> dict[Pair, list[int]]:
    """The ranks of each pair; a pair has several if it was merged, came up again, and was merged again."""
    out: dict[Pair, list[int]] = defaultdict(list)
    for rank, pair in enumerate(merges, start):
        out[pair].append(rank)
    return dict(out)


def merged(parts: list[str], ranks: dict[Pair, list[int]]) -> list[str]:
    """The symbols after every merge in its order: the lowest rank first, from left to right, on a linked list."""
    n = len(parts)
    if n < 2:
        return parts
    heap = [(ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    if not heap:
        return parts
    parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)

    def push(i: int, j: int, rank: int) -> None:
        own = ranks.get((parts[i], parts[j]))
        if own and own[-1] > rank:
            heapq.heappush(heap, (own[bisect_right(own, rank)], i))

    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or rank not in ranks.get((parts[i], parts[j]), ()):
            continue
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i], rank)
        if before[i] >= 0:
            push(before[i], i, rank)
    return [p for p in parts if p]


def _once(parts: list[str], a: str, b: str) -> list[str]:
    out, i, last = [], 0, len(parts) - 1
    while i <= last:
        if i < last and parts[i] == a and parts[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


class _Names:
    """A character for each symbol: its own for a single one, one that no word holds for a longer one and for the end of a word."""

    def __init__(self, words: DataFrame, word: str, mark: str):
        found = words.select(F.explode(symbols(F.col(word), mark)).alias("c")).distinct().collect()  # bounded by Unicode
        self.of = {r.c: r.c for r in found}
        held = set(self.of)
        blocks = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE), range(0x21, 0xD800))
        self.free = (c for block in blocks for c in map(chr, block) if c not in held)
        self.end = next(self.free)
        self.symbol = {c: c for c in held}

    def add(self, symbol: str) -> None:
        if symbol not in self.of:
            self.of[symbol] = c = next(self.free)
            self.symbol[c] = symbol

    def replacements(self, merges: list[Pair]) -> list[tuple[str, str]]:
        return [(self.of[a] + self.of[b], self.of[a + b]) for a, b in merges]


def _texts(batches: Iterator[pa.RecordBatch], swaps: list[tuple[str, str]], end: str) -> Iterator[tuple[str, np.ndarray]]:
    """Many words at once, each behind an `end`, after the merges; and their frequencies."""

    def made(part: list[pa.RecordBatch]) -> tuple[str, np.ndarray]:
        text = end + end.join([w for b in part for w in b.column(0).to_pylist()])
        for old, new in swaps:
            text = text.replace(old, new)
        return text, np.concatenate([b.column(1).to_numpy() for b in part])

    part, n = [], 0
    for batch in batches:
        if batch.num_rows:
            part.append(batch)
            n += batch.num_rows
        if n >= TOGETHER:
            yield made(part)
            part, n = [], 0
    if part:
        yield made(part)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(keys):
        return [], []
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts].tolist(), np.add.reduceat(n, starts).tolist()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _applied(words: DataFrame, pending: list[Pair], names: _Names) -> DataFrame:
    swaps, end = names.replacements(pending), names.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, n in _texts(batches, swaps, end):
            yield pa.RecordBatch.from_arrays([pa.array(text[1:].split(end), pa.string()), pa.array(n, pa.int64())], ["symbols", "frequency"])

    return words.mapInArrow(run, "symbols string, frequency long") if pending else words


def _counted(words: DataFrame, names: _Names) -> DataFrame:
    """(a, b, n), as pair_counts has it."""
    end, symbol = names.end, names.symbol

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for text, n in _texts(batches, [], end):
            c = _codes(text)
            at = np.flatnonzero((c[:-1] != ord(end)) & (c[1:] != ord(end)))
            for k, x in zip(*_summed(c[at] << 21 | c[at + 1], n[np.cumsum(c == ord(end))[at] - 1])):
                total[k] += x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([symbol[chr(k >> 21)] for k in total]), pa.array([symbol[chr(k & 0x1FFFFF)] for k in total]), pa.array([*total.values()], pa.int64())], ["a", "b", "n"])

    return words.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _changes(words: DataFrame, pending: list[Pair], proposed: list[Pair], names: _Names) -> DataFrame:
    """(u, v, n): how often unit v follows unit u where one of them is a chain; how often chain u occurs, where v is null. u is null
    where a chain is too long."""
    swaps, end, longest = names.replacements(pending), names.end, LONG if len(proposed) > 1 else None
    asked = np.sort(np.array([ord(names.of[a]) << 21 | ord(names.of[b]) for a, b in proposed], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str | None, str | None], int] = defaultdict(int)
        for text, n in _texts(batches, swaps, end):
            c = _codes(text)
            pairs = c[:-1] << 21 | c[1:]
            cut = asked[np.minimum(np.searchsorted(asked, pairs), len(asked) - 1)] != pairs
            starts = np.r_[0, np.flatnonzero(cut) + 1]
            lengths = np.diff(np.r_[starts, len(c)])
            if longest and lengths.max() > longest:
                total[None, None] += 1
                continue
            word = np.cumsum(c == ord(end))[starts] - 1
            unit, chain = c[starts], lengths > 1
            ids: dict[str, int] = {}  # chains are numbered behind all characters
            at = np.flatnonzero(chain)
            unit[at] = [ids.setdefault(text[i:j], 0x110000 + len(ids)) for i, j in zip(starts[at].tolist(), (starts + lengths)[at].tolist())]
            listed = [*ids]
            name = lambda x: chr(x) if x < 0x110000 else listed[x - 0x110000]
            for k, x in zip(*_summed(unit[at], n[word[at]])):
                total[name(k), None] += x
            at = np.flatnonzero((chain[:-1] | chain[1:]) & (unit[:-1] != ord(end)) & (unit[1:] != ord(end)))
            for k, x in zip(*_summed(unit[at] << 32 | unit[at + 1], n[word[at]])):
                total[name(k >> 32), name(k & 0xFFFFFFFF)] += x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, n) for k, n in total.items())), (pa.string(), pa.string(), pa.int64()))], ["u", "v", "n"])

    return words.mapInArrow(run, "u string, v string, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


class _Chains:
    """What _changes found, with the merges that were taken since."""

    def __init__(self, rows: list[tuple], names: _Names):
        self.symbol = names.symbol
        self.parts = {u: [names.symbol[c] for c in u] for u, v, _ in rows if v is None}
        self.n = {u: n for u, v, n in rows if v is None}
        self.first, self.last = {u: s[0] for u, s in self.parts.items()}, {u: s[-1] for u, s in self.parts.items()}
        self.right: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.left: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for u, v, n in rows:
            if v is not None:
                if u in self.parts:
                    self.right[u].append((v, n))
                if v in self.parts:
                    self.left[v].append((u, n))
        self.holding: dict[Pair, set[str]] = defaultdict(set)
        for u, s in self.parts.items():
            for p in zip(s, s[1:]):
                self.holding[p].add(u)

    def take(self, a: str, b: str) -> dict[Pair, int]:
        """By how much the merge changes the counts of pairs."""
        by: dict[Pair, int] = defaultdict(int)
        for u in self.holding[a, b]:
            old, n = self.parts[u], self.n[u]
            new = _once(old, a, b)
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                by[p] -= n
            for p in zip(new, new[1:]):
                by[p] += n
            self.parts[u] = new
            if new[-1] != self.last[u]:
                for v, k in self.right[u]:
                    by[self.last[u], self.first.get(v) or self.symbol[v]] -= k
                    by[new[-1], self.first.get(v) or self.symbol[v]] += k
                self.last[u] = new[-1]
            if new[0] != self.first[u]:
                for v, k in self.left[u]:
                    by[self.last.get(v) or self.symbol[v], self.first[u]] -= k
                    by[self.last.get(v) or self.symbol[v], new[0]] += k
                self.first[u] = new[0]
        return {p: n for p, n in by.items() if n}


class _Held:
    """The counts of the most frequent pairs, and the first place in the order that isn't held."""

    def __init__(self, counted: DataFrame, held: int):
        rows = counted.orderBy(F.desc("n"), "a", "b").limit(held + 1).collect()
        self.floor = (-rows[held].n, rows[held].a, rows[held].b) if len(rows) > held else None
        self.n = {(r.a, r.b): r.n for r in rows[:held]}
        self.heap = [(-n, *p) for p, n in self.n.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, str, str] | None:
        """The first in the order, or None if it isn't known to be held."""
        while self.heap and self.n.get(self.heap[0][1:], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap and (self.floor is None or self.heap[0] < self.floor) else None

    def change(self, pair: Pair, by: int) -> None:
        n = self.n.get(pair, 0) + by
        if n > 0 and (pair in self.n or by > 0 and (self.floor is None or (-n, *pair) < self.floor)):
            self.n[pair] = n
            heapq.heappush(self.heap, (-n, *pair))
        else:
            self.n.pop(pair, None)

    def proposed(self, most: int) -> list[Pair]:
        """The first pairs, as far as they are a bounded share of all neighbours, but one at least."""
        out, left = [], SHARE * sum(self.n.values())
        for key in heapq.nsmallest(most, ((-n, *p) for p, n in self.n.items())):
            left += key[0]
            if out and left < 0:
                break
            out.append(key[1:])
        return out


def train(words: DataFrame, merges: int, word: str = "word", count: str = "frequency", mark: str = "▁", proposed: int = PROPOSED, held: int = HELD) -> list[tuple[str, str, int]]:
    """The first merges (a, b, n) of byte-pair counting over a table of distinct words; ties go to the smaller pair. Pairs are merged as
    long as one is left; null words and counts below one do not count."""
    spark = words.sparkSession
    spread = 4 * spark.sparkContext.defaultParallelism  # small words, but much to do for each; every round starts as many tasks
    rows = settled(words.where(F.col(word).isNotNull() & (F.col(count) > 0)).select(F.col(word).alias("word"), F.col(count).cast("long").alias("frequency")))
    names = _Names(rows, "word", mark)
    state = settled(rows.select(F.concat(F.lit(mark), "word").alias("symbols"), "frequency").repartition(spread, "symbols"))
    found: list[tuple[str, str, int]] = []
    pending: list[Pair] = []
    known: _Held | None = None
    made, rounds, most = set(), 0, proposed
    while len(found) < merges:
        if pending and (known is None or rounds >= KEPT_FOR):
            state, pending, rounds = settled(_applied(state, pending, names)), [], 0
        if known is None:
            known = _Held(_counted(state, names), held)
        best = known.best()
        if best is None:
            if not known.n and known.floor is None:
                break  # no pairs are left
            known = None
            continue
        plan = known.proposed(most)
        rows = _changes(state, pending, plan, names)
        rows = [*zip(*(x.to_pylist() for x in (rows.limit(ROWS + 1) if len(plan) > 1 else rows).toArrow().columns))]
        if len(plan) > 1 and (len(rows) > ROWS or any(u is None for u, _, _ in rows)):
            most = len(plan) // 2
            continue
        chains, asked, fresh = _Chains(rows, names), set(plan), set()
        rounds += 1
        while len(found) < merges:
            best = known.best()
            if best is None or best[1:] not in asked or fresh & {*best[1:]}:
                break
            a, b = best[1:]
            found.append((a, b, -best[0]))
            pending.append((a, b))
            fresh.add(a + b)
            names.add(a + b)
            for pair, n in chains.take(a, b).items():
                known.change(pair, n)
            if a + b in made:  # the symbol was there, so pairs that aren't held may have become more frequent
                known = None
                break
            made.add(a + b)
    return found


def encode(word: Column, merges: list[Pair], mark: str = "▁") -> Column:
    """The pieces of a word, the mark in front, after every merge in its order. For distinct words: each costs a Python call."""
    ranks = by_pair(merges)

    @F.pandas_udf("array<string>")
    def pieces(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else merged(list(mark + w), ranks))

    return pieces(word)


def decode(pieces: Column, mark: str = "▁") -> Column:
    return F.ltrim(F.replace(F.array_join(pieces, ""), F.lit(mark), F.lit(" ")))
