"""A hierarchical Pitman-Yor language model over a whole corpus.

Restaurants stand for contexts. The context of a word is made of the last bytes of the word before it: restaurants of the last
two bytes share the parent of the last byte, and those share the one without context, whose base is uniform over the vocabulary
and one unknown word. (Endings bound the restaurants by 65,536 whatever the input is; `wordlm` has whole words as contexts,
and is what the registered query runs.) Restaurants are filled by a power law of their customers. Then, each sweep, all
customers of a dish in a restaurant get up and the number of their tables is drawn anew given the rest, and single customers move
by Gibbs: one gets up, taking an own table away with the probability that the number of tables gives, and sits down again. The
tables of a restaurant are the customers of its parent. Predictive probabilities are averaged over the kept seatings.

How it is dealt out: a task turns blocks of texts into sparse counts and sends, by hash of the word, each shard its part. The
messages to the shard of a very frequent word are dealt to several tasks and summed, round by round, before its dishes are seated in
one; as a word has 65,536 contexts at most, what is summed is bounded. Totals of restaurants in other shards are taken to follow the
share of customers that the shard sees. Then the true totals, one row for each restaurant, are summed over all shards, and the blocks
get their counts and tables back, a frequent word's shard answering from several tasks again, to score their documents. Blocks are
of bounded size and the number of shards grows with the input.

Words are runs of anything but ASCII space, A-Z lower-cased; each text ends with an end token. Null and empty texts have that
token only. Ids are read as text for the split, a null id as the empty text; repeated rows count each. Held-out texts change
nothing of what is learnt, nor each other's scores. Without any training text the one unknown word has probability 1 and every
score is 0. Perplexity is 10 to the negative score a token. Extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, in_slices, settle

#: Bytes of text in a block and, about, in a shard.
BLOCK = 8 << 20
#: Bytes of messages that one task sums or answers, about.
SPLIT = 8 << 20
#: Discount and strength of a restaurant without context, of one byte, of two bytes.
DISCOUNT, STRENGTH = (0.75, 0.8, 0.8), (10.0, 5.0, 2.0)
BURN_IN, SAMPLES, MOVES = 3, 2, 4
_END = b""
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the least type that holds it, compressed. Wide numbers are laid out byte by byte of all, as
    their high bytes are much alike."""
    import zstandard

    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        most = int(a.max(initial=0))
        a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))
        if a.itemsize > 2:
            a = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        out += struct.pack("<BI", len(a) if a.ndim > 1 else a.itemsize, a.shape[-1]), a.tobytes()
    return zstandard.compress(b"".join(out), 7)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(data)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        size, length = struct.unpack_from("<BI", data, at)
        at += 5
        if size > 2:
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size * length, at).reshape(size, length).T).view(f"<u{size}").ravel())
        else:
            out.append(np.frombuffer(data, f"<u{size}", length, at))
        at += size * length
    return out


def in_training(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def _block(ids: list, texts: list[bytes], shards: int) -> tuple[bytes, list[tuple[int, bytes]], tuple[np.ndarray, np.ndarray]]:
    """The documents' entries, each shard's words and counts, and the training tokens of each context."""
    from xxhash import xxh64_intdigest

    place: dict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    place[_END]
    parts = []
    for t in texts:
        words = t.translate(_LOWER).split()
        words.append(_END)
        parts.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
    del texts
    sizes = np.array([len(p) for p in parts])
    tokens = np.concatenate(parts)
    hashes = np.array([xxh64_intdigest(w) for w in place], np.uint64)
    ends = np.array([int.from_bytes(w[-2:], "big") for w in place], np.int64)
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((hashes, shard))
    new = np.diff(hashes[order], prepend=~hashes[order][:1]) != 0  # words of one hash are one
    rank = np.empty_like(order)
    rank[order] = np.cumsum(new) - 1
    hashes, shard = hashes[order][new], shard[order][new]
    before = np.concatenate([[0], ends[tokens[:-1]]])
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 0
    entries, entry = np.unique(rank[tokens] << 16 | before, return_inverse=True)
    train = np.repeat([in_training(i) for i in ids], sizes)
    counts = np.bincount(entry, train, len(entries)).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    entry = np.sort(doc * len(entries) + entry) - doc * len(entries)
    step = np.diff(entry, prepend=0)
    step[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = entry[np.concatenate([[0], np.cumsum(sizes)[:-1]])]
    docs = pack(sizes, step, np.array([in_training(i) for i in ids], np.int64))
    word, context = entries >> 16, entries & 0xFFFF
    per_word = np.bincount(word, minlength=len(hashes))
    word_at, entry_at = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))]), np.concatenate([[0], np.cumsum(per_word)])
    asked = []
    for s in range(shards):
        a, b = word_at[s], word_at[s + 1]
        if a < b:
            x, y = entry_at[a], entry_at[b]
            asked.append((s, pack(hashes[a:b], per_word[a:b], context[x:y], counts[x:y])))
    by_context = np.bincount(context, counts, 65536)
    seen = np.flatnonzero(by_context)
    return docs, asked, (seen, by_context[seen].astype(np.int64))


def lone_shares(discount: float, most: int = 64) -> np.ndarray:
    """[c, t]: the probability that one of c customers at t tables sits alone, from generalised Stirling numbers."""
    s = np.zeros((most + 1, most + 2))
    alone = np.zeros_like(s)
    s[1, 1] = 1.0
    for c in range(2, most + 1):
        t = np.arange(1, c + 1)
        new, joined = s[c - 1, t - 1], np.maximum(c - 1 - discount * t, 0) * s[c - 1, t]
        s[c, t] = new + joined
        alone[c, t] = new / np.maximum(s[c, t], 1e-300)
        s[c] /= s[c].max()  # only ratios within a row count
    return alone


@lru_cache(maxsize=8)
def log_seatings(discount: float, most: int = 512) -> np.ndarray:
    """[c, t]: log of the summed weights of all seatings of c customers at t tables."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - discount * t, 1e-300)) + s[c, t])
    return s


class Level:
    """The restaurants of one length of context within a shard: c customers at t tables for each dish, u the restaurant."""

    def __init__(self, dish: np.ndarray, u: np.ndarray, discount: float, strength: float, rng: np.random.Generator):
        self.dish, self.u, self.d, self.s, self.rng = dish, u, discount, strength, rng
        self.alone, self.ways = lone_shares(discount), log_seatings(discount)
        self.c = self.t = np.zeros(len(dish), np.int64)

    def seat(self, c: np.ndarray, opening: np.ndarray) -> None:
        """First seating, one after another: exact for the first customers, then in growing strides. opening: weight of a new table."""
        self.c, t, n = c, np.minimum(c, 1), 1
        live = np.flatnonzero(c > 1)
        while len(live):
            n_next = n + 1 if n < 16 else n + n // 4
            many = np.minimum(c[live], n_next) - n
            p = opening[live] / (opening[live] + np.maximum(n - self.d * t[live], 1e-9))
            new = self.rng.random(len(live)) < p if n_next == n + 1 else self.rng.poisson(p * many)
            t[live] = np.minimum(t[live] + new, c[live])
            n = n_next
            live = live[c[live] > n]
        self.t = t

    def fill(self, c: np.ndarray) -> None:
        """Tables to begin with, between the power law of the discount and one a customer: near what many sweeps come to."""
        self.c, self.t = c, np.ceil(c.astype(np.float64) ** ((1 + self.d) / 2)).astype(np.int64)

    def reseat(self, c: np.ndarray, opening: np.ndarray, by_table: np.ndarray) -> None:
        """All customers of each dish get up and their number of tables is drawn anew, given the rest. opening: weight of a new
        table at the present number of tables; by_table: what each table adds to it. Up to 512 customers are drawn from the exact
        distribution, more from one of its mean and variance."""
        t = np.minimum(c, 1)
        first = np.maximum(opening - by_table * np.maximum(self.t - 1, 0), 1e-300)  # weight of the second table
        most = self.ways.shape[0] - 1
        live = np.flatnonzero((c > 1) & (c <= most))
        live = live[np.argsort(c[live], kind="stable")]
        sizes, starts = np.unique(c[live], return_index=True)
        for n, a, b in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(live)]):
            step = max(1, (1 << 20) // n)
            for at in range(a, b, step):
                i = live[at : min(b, at + step)]
                gain = np.log(first[i][:, None] + by_table[i][:, None] * np.arange(n - 1))
                weight = np.concatenate([np.zeros((len(i), 1)), np.cumsum(gain, axis=1)], axis=1) + self.ways[n, 1 : n + 1]
                up = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                t[i] = 1 + (up < (self.rng.random(len(i)) * up[:, -1])[:, None]).sum(axis=1)
        many = np.flatnonzero(c > most)
        if len(many):
            mean, var = self.expected(c[many], first[many], by_table[many])
            # counts of that mean and variance: binomial if narrower than Poisson, else Poisson of a gamma
            narrow = var < mean * (1 - 1e-6)
            n = np.where(narrow, np.ceil(mean * mean / np.where(narrow, mean - var, 1)), 1)
            n = np.maximum(n, np.ceil(mean))
            rate = np.where(var > mean * (1 + 1e-6), self.rng.gamma(mean * mean / np.maximum(var - mean, 1e-12)) * np.maximum(var - mean, 0) / np.maximum(mean, 1e-300), mean)
            drawn = np.where(narrow, self.rng.binomial(np.minimum(n, 2**62).astype(np.int64), np.minimum(mean / n, 1)), self.rng.poisson(rate))
            t[many] = np.minimum(1 + drawn, c[many])
        self.c, self.t = c, t

    def expected(self, c: np.ndarray, first: np.ndarray, by_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the tables besides the first customer's own, by a saddle point. Sizes of tables have the generating
        function f(x) = (1 - (1 - x)^d) / d; one customer's table has f'(x), the others (1 - b f(x))^-(first / b)."""
        d, b, n = self.d, np.maximum(by_table, 1e-300), c - 1.0

        def at(y):  # y = 1 - x
            f = -np.expm1(d * np.log(y)) / d
            return f, first / (1 - b * f), (1 - y) * y ** (d - 1)

        low, high = np.full(len(c), -700.0), np.zeros(len(c))
        for _ in range(60):
            middle = (low + high) / 2
            y = np.exp(middle)
            f, a, xf = at(y)
            more = (1 - d) * (1 - y) / y + a * xf > n
            low, high = np.where(more, middle, low), np.where(more, high, middle)
        y = np.exp(high)
        f, a, xf = at(y)
        slope = a * b / (1 - b * f)
        xxf = xf + (1 - d) * (1 - y) ** 2 * y ** (d - 2)  # x (x f')'
        own = (1 - d) * (1 - y) / y**2
        spread = own + slope * xf * xf + a * xxf
        both = slope * xf * f + a * xf
        return a * f, np.maximum(slope * f * f + a * f - both * both / spread, 1e-12)

    def gibbs(self, c: np.ndarray, opening: np.ndarray, by_table: np.ndarray, moves: int) -> None:
        """All customers of each dish are seated anew, then single ones get up and sit down again, `moves` of each dish in each restaurant. by_table: of what opening loses with a table.

        The probability that the one who gets up sat alone is exact up to 64 customers; beyond that it is d * tables / customers, what it
        tends to. reseat() has drawn their tables by then, so these moves only add to the mixing."""
        before = self.t
        self.reseat(c, opening, by_table)
        t = self.t
        opening = np.maximum(opening + by_table * (t - before), 0)
        live = np.flatnonzero(c > 1)
        n, x = c[live], t[live]
        small = np.minimum(n, self.alone.shape[0] - 1)
        for _ in range(moves):
            share = np.where(n == small, self.alone[small, np.minimum(x, small)], np.where(x > 1, np.minimum(self.d * x / n, 1), 0))
            x = x - (self.rng.random(len(x)) < share)
            new = np.maximum(opening[live] + by_table[live] * (x - t[live]), 0)
            x = x + (self.rng.random(len(x)) * (new + n - 1 - self.d * x) < new)
        t[live] = x
        self.t = t

    def totals(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.u, values, size)


def seat_shard(word: np.ndarray, context: np.ndarray, c: np.ndarray, by_context: np.ndarray, shards: int, seed: int) -> tuple[list[Level], np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """Seats a shard's dishes. Returns the levels, the level-1 entry of each entry, and (c, t) of each level in each kept sample."""
    rng = np.random.default_rng(seed)
    n_words = int(word.max(initial=-1)) + 1
    pairs, up = np.unique(word << 8 | context & 0xFF, return_inverse=True)
    levels = [Level(np.arange(n_words), np.zeros(n_words, np.int64), DISCOUNT[0], STRENGTH[0], rng), Level(pairs >> 8, pairs & 0xFF, DISCOUNT[1], STRENGTH[1], rng), Level(word, context, DISCOUNT[2], STRENGTH[2], rng)]
    sizes = (1, 256, 65536)
    everywhere = [np.array([by_context.sum()]), np.bincount(np.arange(65536) & 0xFF, by_context, 256), by_context]
    here = [np.bincount(level.u, x, size) for level, x, size in zip(levels, (np.bincount(word, c, n_words), np.bincount(up, c, len(pairs)), c), sizes)]
    scale = [np.where(b > 0, a / np.maximum(b, 1), 1.0) for a, b in zip(everywhere, here)]
    vocabulary = max(1, n_words) * shards + 1
    customers = [np.zeros(n_words), np.zeros(len(pairs)), c]
    for k in (2, 1, 0):  # filled before the first seating, so that its openings are not those of empty restaurants
        if k < 2:
            customers[k] = np.bincount(up if k == 1 else levels[1].dish, levels[k + 1].t, len(levels[k].dish)).astype(np.int64)
        levels[k].fill(customers[k])
    kept = []
    for sweep in range(BURN_IN + SAMPLES):
        # top down: what each restaurant expects of a dish, given the present seating; then bottom up: new seatings
        base, opening = np.full(n_words, 1 / vocabulary), [None] * 3
        per_table = [None] * 3
        for k, level in enumerate(levels):
            parent = base if k == 0 else predictive[level.dish] if k == 1 else predictive[up]
            tables, all_customers = level.totals(level.t, sizes[k]) * scale[k], level.totals(level.c, sizes[k]) * scale[k]
            weight = (level.s + level.d * tables)[level.u]
            opening[k], per_table[k] = weight * parent, level.d * parent
            predictive = (np.where(level.c > 0, level.c - level.d * level.t, 0) + opening[k]) / (level.s + all_customers)[level.u]
        for k in (2, 1, 0):
            level = levels[k]
            if k < 2:
                below = levels[k + 1]
                customers[k] = np.bincount(up if k == 1 else below.dish, below.t, len(level.dish)).astype(np.int64)
            level.gibbs(customers[k], opening[k], per_table[k], MOVES)
        if sweep >= BURN_IN:
            kept.append([(level.c, level.t) for level in levels])
    return levels, up, kept


def _gather(messages: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of messages (hashes, entries of each word, contexts, counts): the distinct words in order, the place of each message's words in
    them, the distinct entries (place << 16 | context), the place of each message's entries in them, and the summed counts."""
    names, word_of = np.unique(np.concatenate([a[0] for a in messages]).astype(np.uint64), return_inverse=True)
    word = np.repeat(word_of, np.concatenate([a[1] for a in messages]))
    context = np.concatenate([a[2] for a in messages]).astype(np.int64)
    entries, entry = np.unique(word << 16 | context, return_inverse=True)
    return names, word_of, entries, entry, np.bincount(entry, np.concatenate([a[3] for a in messages]), len(entries)).astype(np.int64)


def _learnt(names: np.ndarray, entries: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """As a message, what training texts hold."""
    words, word = np.unique(entries[c > 0] >> 16, return_inverse=True)
    return [names[words], np.bincount(word, minlength=len(words)), entries[c > 0] & 0xFFFF, c[c > 0]]


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    names, _, entries, _, c = _gather([unpack(x) for x in rows["data"]])
    return pd.DataFrame([(int(rows["block"].min()), key[0], pack(*_learnt(names, entries, c)))], columns=["block", "shard", "data"])


def _seat(key: tuple, rows: pd.DataFrame, by_context: np.ndarray, shards: int) -> pd.DataFrame:
    """The shard's seatings, and totals: what 0 is N and V, else 1 + 2 * level (+ 1 for customers), at a restaurant and sample."""
    names, _, entries, _, c = _gather([unpack(x) for x in rows["data"]])  # sums, so the order in which rows arrive is nothing to it
    names, per_word, context, c = _learnt(names, entries, c)
    word = np.repeat(np.arange(len(names)), per_word)
    levels, _, kept = seat_shard(word, context, c, by_context, shards, int(key[0]))
    state = [names, per_word, context, c]
    for (c0, t0), (c1, t1), (_, t2) in kept:
        state += [t2, c1, t1, c0, t0]
    out = [(key[0], pack(*state), -1, 0, 0, 0), (None, None, 0, 0, 0, int(c.sum())), (None, None, 0, 1, 0, len(names))]
    for s, sample in enumerate(kept):
        for k, (cs, ts) in enumerate(sample):
            for customers, x in ((0, ts), (1, cs)):
                total = np.bincount(levels[k].u, x, 1)
                out += [(None, None, 1 + 2 * k + customers, int(u), s, int(total[u])) for u in np.flatnonzero(total)]
    return pd.DataFrame(out, columns=["shard", "data", "what", "at", "sample", "n"])


def _found(of: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in sorted ones, and whether they are there."""
    if not len(among):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return at, among[at] == of


def _answer(key: tuple, asked: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """To each block, what the shard's seatings say of its words and entries; those of no training text have nothing."""
    names, per_word, context, c, *samples = unpack(states["data"].iloc[0])
    word = np.repeat(np.arange(len(names)), per_word)
    entries, counts = word << 16 | context, np.bincount(word, c, len(names)).astype(np.int64)
    pairs = np.unique(entries >> 16 << 8 | entries & 0xFF)
    out = []
    for block, data in zip(asked["block"], asked["data"]):
        hashes, per_word, context, _ = (x.astype(np.int64 if i else np.uint64) for i, x in enumerate(unpack(data)))
        w, known = _found(hashes, names)
        at, holds = _found(np.repeat(w, per_word) << 16 | context, entries)
        holds &= np.repeat(known, per_word)
        own = np.unique(np.repeat(np.arange(len(hashes)), per_word) << 8 | context & 0xFF)  # as the block will have them
        pair, there = _found(w[own >> 8] << 8 | own & 0xFF, pairs)
        there &= known[own >> 8]
        told = lambda x, at, holds: np.where(holds, x[at], 0).astype(np.int64) if len(x) else np.zeros(len(at), np.int64)
        count, of_entry = told(counts, w, known), told(c, at, holds)
        answer = [per_word, context, count, of_entry]
        for s in range(SAMPLES):
            t2, c1, t1, c0, t0 = samples[5 * s : 5 * s + 5]
            c1, c0 = told(c1, pair, there), told(c0, w, known)
            # one customer or none has as many tables
            answer += [told(t2, at, holds)[of_entry > 1], c1, told(t1, pair, there)[c1 > 1], c0[count > 1], told(t0, w, known)[c0 > 1]]
        out.append((block, key[0], pack(*answer)))
    return pd.DataFrame(out, columns=["block", "shard", "data"])


def _whole(of: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What a block is told only where `of` is above 1; it equals `of` elsewhere."""
    out = of.copy()
    out[of > 1] = rest
    return out


def _score(answers: list[list[np.ndarray]], totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry of a block: log10 of the averaged probability, log10 of the base, whether the word is known."""
    n_all, v = totals["N"], totals["V"]
    model, base, known = [], [], []
    for answer in answers:
        per_word, context, count, c, *samples = (x.astype(np.int64) for x in answer)
        word = np.repeat(np.arange(len(per_word)), per_word)
        pairs, pair = np.unique(word << 8 | context & 0xFF, return_inverse=True)
        p = np.zeros(len(context))
        for s in range(SAMPLES):
            t2, c1, t1, c0, t0 = samples[5 * s : 5 * s + 5]
            t2, t1, c0 = _whole(c, t2), _whole(c1, t1), _whole(count, c0)
            t0 = _whole(c0, t0)
            tables, customers = totals["tables"][s], totals["customers"][s]
            p0 = (np.where(c0 > 0, c0 - DISCOUNT[0] * t0, 0) + (STRENGTH[0] + DISCOUNT[0] * tables[0][0]) / (v + 1)) / (STRENGTH[0] + customers[0][0])
            u = pairs & 0xFF
            p1 = (np.where(c1 > 0, c1 - DISCOUNT[1] * t1, 0) + (STRENGTH[1] + DISCOUNT[1] * tables[1][u]) * p0[pairs >> 8]) / (STRENGTH[1] + customers[1][u])
            p += (np.where(c > 0, c - DISCOUNT[2] * t2, 0) + (STRENGTH[2] + DISCOUNT[2] * tables[2][context]) * p1[pair]) / (STRENGTH[2] + customers[2][context])
        model.append(np.log10(p / SAMPLES))
        base.append(np.log10((count.astype(np.float64) + 1) / (n_all + v + 1))[word])
        known.append((count > 0)[word])
    return np.concatenate(model), np.concatenate(base), np.concatenate(known)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row, learnt from the training rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trains = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    size = rows.where(trains).agg(F.sum(F.octet_length("text"))).first()[0] or 0  # held-out texts have no say in anything
    shards = max(1, -(-size // block))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = part << 32 | seq
            ids = pa.concat_arrays([b.column(0) for b in held])
            docs_data, asked, (seen, n) = _block(ids.to_pylist(), [t for b in held for t in byte_values(b.column(1))], shards)
            kinds = ["d", *"q" * len(asked), *"u" * len(seen)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array([number] * len(kinds), pa.int64()), pa.array([None, *(s for s, _ in asked), *seen.tolist()], pa.int64()), pa.array([docs_data, *(x for _, x in asked), *[None] * len(seen)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * len(kinds)], pa.int32()), pa.StructArray.from_arrays([ids], ["id"])), pa.array([0] * (1 + len(asked)) + n.tolist(), pa.int64())],
                ["kind", "block", "shard", "data", "ids", "n"],
            )

        held, held_bytes = [], 0
        for batch in in_slices(batches, "text", block):
            col = batch.column(1)
            n = pc.sum(pc.binary_length(col)).as_py() or 0
            if held and held_bytes + n > block:
                yield from made(held)
                held, held_bytes, seq = [], 0, seq + 1
            held.append(batch)
            held_bytes += n
        if held:
            yield from made(held)

    kind = docs.schema[id_col].dataType.simpleString()
    sent = settle(rows.mapInArrow(cut, f"kind string, block long, shard long, data binary, ids array<struct<id:{kind}>>, n long"))
    by_context = np.zeros(65536, np.int64)
    for r in sent.where("kind = 'u'").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        by_context[r.shard] = r.n
    asked = sent.where("kind = 'q'").select("block", "shard", "data")

    def parts(messages: DataFrame) -> DataFrame:
        """(shard, parts) of the shards that get more than one task should hold: those of the most frequent words."""
        return messages.groupBy("shard").agg(F.ceil(F.sum(F.length("data")) / split).cast("int").alias("parts")).where("parts > 1")

    def dealt(messages: DataFrame, hot: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1)))
        return messages.join(F.broadcast(hot), "shard", "left").withColumn("part", part).drop("parts")  # a row for each `split` bytes of messages at most

    crowded = hot = settle(parts(asked))
    messages = asked
    while not crowded.isEmpty():  # their messages are summed by parts, until what is left fits
        merged = dealt(messages, crowded).join(F.broadcast(crowded.select("shard")), "shard", "left_semi").groupBy("shard", "part").applyInPandas(lambda key, x: _merge(key, x), "block long, shard long, data binary")
        rest = messages.join(F.broadcast(crowded.select("shard")), "shard", "left_anti")
        before, messages = crowded, rest.unionByName(settle(merged))
        crowded = settle(parts(messages).join(F.broadcast(before.withColumnRenamed("parts", "_parts")), "shard").where("parts < _parts").drop("_parts"))
    seated = settle(messages.groupBy("shard").applyInPandas(lambda key, x: _seat(key, x, by_context, shards), "shard long, data binary, what int, at int, sample int, n long"))
    totals = {"N": 0, "V": 0, "tables": [[np.zeros(n) for n in (1, 256, 65536)] for _ in range(SAMPLES)], "customers": [[np.zeros(n) for n in (1, 256, 65536)] for _ in range(SAMPLES)]}
    for r in seated.where("what >= 0").groupBy("what", "at", "sample").agg(F.sum("n").alias("n")).collect():  # one for each restaurant and sample
        if r.what == 0:
            totals["V" if r["at"] else "N"] = r.n
        else:
            totals["customers" if (r.what - 1) % 2 else "tables"][r["sample"]][(r.what - 1) // 2][r["at"]] = r.n
    told = docs.sparkSession.sparkContext.broadcast(totals)

    def finish(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        totals = told.value
        ids, (sizes, step, train) = [x["id"] for x in own["ids"].iloc[0]], unpack(own["data"].iloc[0])  # in structs, as an array with a null would be of floats
        model, base, known = _score([unpack(x) for x in answers.sort_values("shard")["data"]], totals)
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        run = np.cumsum(step, dtype=np.int64)
        before = np.concatenate([[0], run])[starts[:-1]]
        entry = run - np.repeat(before, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        total = lambda x: np.bincount(doc, x[entry], len(sizes))
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "held_out": train == 0, "n_tokens": sizes.astype(np.int64), "n_known": total(known).astype(np.int64), "train_tokens": np.full(len(sizes), totals["N"], np.int64), "base_score": total(base), "score": total(model)})

    states = seated.where("what < 0").select("shard", "data").join(F.broadcast(hot), "shard", "left")
    states = states.select("shard", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
    answers = dealt(asked, hot).groupBy("shard", "part").cogroup(states.groupBy("shard", "part")).applyInPandas(_answer, "block long, shard long, data binary")
    own = sent.where("kind = 'd'").select("block", "data", "ids")
    out = own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
