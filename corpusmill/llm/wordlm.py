"""A hierarchical Pitman-Yor language model whose contexts are whole previous words.

Every word (and the end of a text, before a first word) is a restaurant of the words that follow it; all share one parent without
context, whose base is uniform over the vocabulary and one unknown word. A sweep draws the number of tables of every dish in every
restaurant anew, given the rest; tables of a restaurant are customers of the parent. A dish of one customer has one table.
Predictive probabilities are averaged over the kept sweeps, with the true totals of every restaurant.

How it is dealt out: blocks of texts send their pairs of words, by hash of the first, to shards, so that a restaurant is whole in one
shard. The restaurants of the words that are most frequent in a sample (`HOT` of them) are dealt out by dish instead; their totals go
through the driver. The parent's dishes are dealt out by hash of the word. A sweep sends the tables of dishes of several customers to
the parent, and the parent's counts back. The words of the sample also have short names in messages; all others go by 63 bits of
hash, so the sample decides on the size of messages and on who draws, on nothing else. Blocks are of bounded size and the number of
shards grows with the input.

Words, ids, nulls, repeated rows and held-out texts are as in `hpylm`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, in_slices, settle
from .hpylm import _END, _LOWER, Level, _found, in_training, pack, unpack

#: Bytes of text in a block, and about in a shard.
BLOCK, SHARD = 8 << 20, 16 << 20
#: Words with short names, bytes of the sample that they are taken from, and restaurants that are dealt out by dish.
NAMED, SAMPLE, HOT = 1 << 18, 32 << 20, 257
#: Discount and strength without context, and of a word.
DISCOUNT, STRENGTH = (0.75, 0.8), (10.0, 2.0)
BURN_IN, SAMPLES, INNER = 1, 2, 2
_FAR = np.uint64(1 << 63)
_ROW = "kind string, shard long, other long, data binary, n long"
_COLUMNS = ["kind", "shard", "other", "data", "n"]


def _codes(hashes: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Short names, else the hash with its highest bit set."""
    at, named = _found(hashes, names[0])
    out = hashes | _FAR
    out[named] = names[1][at[named]]
    return out


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _apart(codes: np.ndarray) -> list[np.ndarray]:
    """Sorted codes as steps between short names, and hashes."""
    short = int(np.searchsorted(codes, _FAR))
    return [np.diff(codes[:short], prepend=np.uint64(0)), codes[short:] ^ _FAR]


def _together(steps: np.ndarray, far: np.ndarray) -> np.ndarray:
    return np.concatenate([np.cumsum(steps, dtype=np.uint64), far.astype(np.uint64) | _FAR])


def _entries(tokens: np.ndarray, per_shard: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (word before, word, shard) in order of shard, word before and word, and each token's pair."""
    n = int(per_shard.sum())
    before = np.roll(tokens, 1)  # every text ends with the end token, which is also the word before a first one
    pairs, inverse = np.unique(before * n + tokens, return_inverse=True)
    u, w = pairs // n, pairs % n
    shard = np.repeat(np.arange(len(per_shard)), per_shard)
    is_hot = np.zeros(n, bool)
    is_hot[hot] = True
    s = np.where(is_hot[u], shard[w], shard[u])
    order = np.argsort(s, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return u[order], w[order], s[order], place[inverse]


def _block(ids: list, texts: list[bytes], shards: int, names: tuple[np.ndarray, np.ndarray], most: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The documents as numbers of words, and each shard's words and pairs."""
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
    sizes, tokens = np.array([len(p) for p in parts]), np.concatenate(parts)
    code = _codes(np.array([xxh64_intdigest(w) for w in place], np.uint64), names)
    code[0] = 0
    shard = _shard(code, shards)
    order = np.lexsort((code, shard))
    new = np.diff(code[order], prepend=~code[order][:1]) != 0  # words of one hash are one
    rank = np.empty_like(order)
    rank[order] = np.cumsum(new) - 1
    code, shard, tokens = code[order][new], shard[order][new], rank[tokens]
    per_shard, hot = np.bincount(shard, minlength=shards), np.flatnonzero(code < most)
    trains = np.array([in_training(i) for i in ids])
    u, w, s, entry = _entries(tokens, per_shard, hot)
    c = np.bincount(entry, np.repeat(trains, sizes), len(u)).astype(np.int64)
    word_at, entry_at = np.concatenate([[0], np.cumsum(per_shard)]), np.searchsorted(s, np.arange(shards + 1))
    asked = []
    for k in range(shards):
        a, b, x, y = word_at[k], word_at[k + 1], entry_at[k], entry_at[k + 1]
        if a < b or x < y:
            used = np.unique(np.concatenate([np.arange(a, b), u[x:y], w[x:y]]))
            used = used[np.argsort(code[used])]
            at = np.empty(len(code), np.int64)
            at[used] = np.arange(len(used))
            first = np.flatnonzero(np.diff(u[x:y], prepend=-1))
            asked.append((k, pack(*_apart(code[used]), at[u[x:y]][first], np.diff(first, append=y - x), at[w[x:y]], c[x:y])))
    return pack(sizes, trains.astype(np.int64), per_shard, hot, code[hot], tokens), asked


def _row(kind: str, shard: int, other: int, *arrays: np.ndarray, n: int = 0) -> tuple:
    return kind, int(shard), int(other), pack(*arrays), int(n)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _hot_rows(shard: int, hot: np.ndarray) -> list[tuple]:
    return [("h", shard, int(i), None, int(hot.flat[i])) for i in np.flatnonzero(hot)]


def _ints(data: bytes) -> list[np.ndarray]:
    return [x.astype(np.int64) for x in unpack(data)]


def _first(key: tuple, rows: pd.DataFrame, shards: int, most: int) -> pd.DataFrame:
    """Sums a shard's pairs. Rows: c, what a block asked for; i, where that is; o, the shard's words; l, dishes of several customers;
    p, what the parent gets; h, customers, dishes of one and tables of the others in hot restaurants; n, training tokens, and words that are
    not hot."""
    me, messages = int(key[0]), []
    for data in rows["data"]:
        steps, far, *rest = unpack(data)
        messages.append((_together(steps, far), *rest))
    names = np.unique(np.concatenate([m[0] for m in messages]))
    at = [np.searchsorted(names, m[0]) for m in messages]
    keys = [np.repeat(a[m[1]], m[2]) << 32 | a[m[3]] for a, m in zip(at, messages)]
    entries = np.unique(np.concatenate(keys))
    c = np.zeros(len(entries), np.int64)
    place = [np.searchsorted(entries, k) for k in keys]
    del keys
    for p, m in zip(place, messages):
        c[p] += m[4]  # a block names a pair once
    u, w = entries >> 32, entries & 0xFFFFFFFF
    of_u = np.bincount(u, c, len(names)).astype(np.int64)
    lone = np.bincount(u[c == 1], minlength=len(names))
    n_hot = int(np.searchsorted(names, np.uint64(most)))
    own = np.flatnonzero(_shard(names, shards) == me)
    own_at = np.full(len(names), -1)
    own_at[own] = np.arange(len(own))
    live = np.cumsum(c > 1) - 1
    out = []
    for block, m, a, p in zip(rows["other"], messages, at, place):
        mine = a[own_at[a] >= 0]
        out.append(_row("c", me, block, c[p], np.where(mine < n_hot, 0, of_u[mine])))
        out.append(_row("i", me, block, live[p[c[p] > 1]], own_at[mine]))
    # live dishes, their words in order of the parent's shards
    lu, lw, lc = u[c > 1], w[c > 1], c[c > 1]
    dishes = np.unique(lw)
    to = _shard(names[dishes], shards)
    dishes = dishes[np.argsort(to, kind="stable")]
    to = np.sort(to)
    dish_at = np.zeros(len(names), np.int64)
    dish_at[dishes] = np.arange(len(dishes))
    rooms, room = np.unique(lu, return_inverse=True)
    hot_name = np.where(names[rooms] < np.uint64(most), names[rooms] + np.uint64(1), np.uint64(0)).astype(np.int64)  # 1 and up: a hot one
    level = Level(dish_at[lw], room, DISCOUNT[1], STRENGTH[1], None)
    level.fill(lc)
    out.append(_row("l", me, 0, room, dish_at[lw], lc, lone[rooms], hot_name, np.bincount(to, minlength=shards)))
    out.append(_row("t", me, 0, level.t))
    room_at = np.zeros(len(names), np.int64)
    room_at[rooms] = np.arange(len(rooms)) + 1
    out.append(_row("o", me, 0, *_apart(names[own]), lone[own], room_at[own]))
    words = np.unique(w[c > 0])
    alone, tables = np.bincount(w[c == 1], minlength=len(names)), np.bincount(lw, level.t, len(names)).astype(np.int64)
    is_live = np.zeros(len(names), np.int64)
    is_live[dishes] = 1
    whose = _shard(names[words], shards)
    for k in np.unique(whose):
        x = words[whose == k]
        out.append(_row("p", k, me, *_apart(names[x]), alone[x], is_live[x], tables[x[is_live[x] > 0]]))
    hot = np.zeros((3, most), np.int64)
    hot[:, names[:n_hot].astype(np.int64)] = of_u[:n_hot], lone[:n_hot], np.bincount(lu, level.t, len(names))[:n_hot]
    return _frame([*out, *_hot_rows(me, hot), ("n", me, 0, None, int(c.sum())), ("n", me, 1, None, int((of_u[n_hot:] > 0).sum()))])


def _parent(key: tuple, rows: pd.DataFrame, sweep: int, vocabulary: int) -> pd.DataFrame:
    """Draws the tables of the parent's dishes. Rows: R, the shard's words and who has them; r, customers and tables; b, those of the
    words that another shard draws with; s, their sums."""
    me = int(key[0])
    values = dict(zip(rows["other"][rows["kind"] == ("v" if sweep else "p")], rows["data"][rows["kind"] == ("v" if sweep else "p")]))
    out = []
    if sweep == 0:
        told = {}
        for other in sorted(values):
            steps, far, *rest = unpack(values[other])
            told[other] = (_together(steps, far), *(x.astype(np.int64) for x in rest))
        names = np.unique(np.concatenate([m[0] for m in told.values()]))
        fixed, who, places, sums = np.zeros(len(names), np.int64), [], [], []
        for other, (codes, alone, is_live, tables) in told.items():
            at = np.searchsorted(names, codes)
            fixed[at] += alone
            who.append(other)
            places.append(at[is_live > 0])
            sums.append(tables)
        out.append(_row("R", me, 0, *_apart(names), fixed, np.array(who), *places))
    else:
        steps, far, fixed, who, *places = unpack(rows["data"][rows["kind"] == "R"].iloc[0])
        fixed, who, sums = fixed.astype(np.int64), who.tolist(), [_ints(values[k])[0] if k in values else np.zeros(0, np.int64) for k in who.tolist()]
    c = fixed.copy()
    for at, x in zip(places, sums):
        c[at] += x
    level = Level(np.arange(len(c)), np.zeros(len(c), np.int64), DISCOUNT[0], STRENGTH[0], np.random.default_rng([me, sweep, 0]))
    level.fill(c)
    share = vocabulary / max(1, len(c))  # of the parent's tables, as of its words
    base = np.full(len(c), 1 / (vocabulary + 1))
    for _ in range(2 * INNER):
        level.reseat(c, (level.s + level.d * level.t.sum() * share) * base, level.d * base)
    out.append(_row("r", me, sweep, c, level.t))
    for k, at in zip(who, places):
        out.append(_row("b", k, me, c[at], level.t[at]))
    return _frame([*out, ("s", me, 0, None, int(c.sum())), ("s", me, 1, None, int(level.t.sum()))])


def _below(c: np.ndarray, t: np.ndarray, root: tuple[int, int, int]) -> np.ndarray:
    """Probability without context; root: customers, tables, vocabulary."""
    customers, tables, v = root
    return (np.where(c > 0, c - DISCOUNT[0] * t, 0) + (STRENGTH[0] + DISCOUNT[0] * tables) / (v + 1)) / (STRENGTH[0] + customers)


def _draw(key: tuple, rows: pd.DataFrame, sweep: int, root: tuple[int, int, int], hot_tables: np.ndarray) -> pd.DataFrame:
    """Draws the tables of a shard's live dishes. hot_tables: of hot restaurants, in all shards, before this sweep."""
    me, kind = int(key[0]), rows["kind"]
    room, dish, c, lone, hot_name, per_shard = _ints(rows["data"][kind == "l"].iloc[0])
    (t,) = _ints(rows["data"][kind == "t"].iloc[0])
    back = dict(zip(rows["other"][kind == "b"], rows["data"][kind == "b"]))
    given = [_ints(back[k]) for k in range(len(per_shard)) if per_shard[k]]
    empty = [np.zeros(0, np.int64)]
    p = _below(np.concatenate([x[0] for x in given] or empty), np.concatenate([x[1] for x in given] or empty), root)[dish]
    level = Level(dish, room, DISCOUNT[1], STRENGTH[1], np.random.default_rng([me, sweep, 1]))
    level.c, level.t = c, t
    is_hot = hot_name > 0
    fixed = np.where(is_hot, hot_tables[np.maximum(hot_name - 1, 0)] - np.bincount(room, t, len(lone)), lone)  # with those elsewhere
    for _ in range(INNER):
        tables = (fixed + np.bincount(room, level.t, len(lone)))[room]
        level.reseat(c, (level.s + level.d * tables) * p, level.d * p)
    out = [_row("t", me, sweep, level.t)]
    sums, edges = np.bincount(dish, level.t, int(per_shard.sum())).astype(np.int64), np.concatenate([[0], np.cumsum(per_shard)])
    out += [_row("v", k, me, sums[edges[k] : edges[k + 1]]) for k in np.flatnonzero(per_shard)]
    hot = np.zeros(len(hot_tables), np.int64)
    hot[hot_name[is_hot] - 1] = np.bincount(room, level.t, len(lone)).astype(np.int64)[is_hot]
    return _frame([*out, *_hot_rows(me, hot)])


def _answer(key: tuple, rows: pd.DataFrame, sweeps: list[int]) -> pd.DataFrame:
    """To each block, of every kept sweep: the tables of its pairs of several customers, of its words' restaurants, and the parent's
    customers and tables of its words."""
    me, kind = int(key[0]), rows["kind"]
    one = lambda k, s=0: rows["data"][(kind == k) & (rows["other"] == s)]
    steps, far, lone, room_at = unpack(one("o").iloc[0])
    names, lone, room_at = _together(steps, far), lone.astype(np.int64), room_at.astype(np.int64)
    room = _ints(one("l").iloc[0])[0]
    known, holds = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    if len(one("R")):
        steps, far, *_ = unpack(one("R").iloc[0])
        known, holds = _found(names, _together(steps, far))
    kept = []
    for s in sweeps:
        (t,) = _ints(one("t", s).iloc[0])
        tables = lone + np.concatenate([[0], np.bincount(room, t)]).astype(np.int64)[room_at]
        c0, t0 = ([np.where(holds, x[known], 0) for x in _ints(one("r", s).iloc[0])] if holds.any() else [np.zeros(len(names), np.int64)] * 2)
        kept.append((t, tables, c0, t0))
    out = []
    for block, data in zip(rows["other"][kind == "i"], rows["data"][kind == "i"]):
        live, own = unpack(data)
        out.append(_row("a", me, block, *[x for t, tables, c0, t0 in kept for x in (t[live], tables[own], c0[own], t0[own])]))
    return _frame(out)


def _scored(docs: bytes, answers: list[tuple[bytes, bytes]], totals: dict) -> dict[str, np.ndarray]:
    """Columns of a block's documents, from what the shards say, in order of shards."""
    sizes, trains, per_shard, hot, name, tokens = _ints(docs)
    u, w, _, entry = _entries(tokens, per_shard, hot)
    counts, samples = [_ints(x) for x, _ in answers], [_ints(x) for _, x in answers]
    c, count = (np.concatenate([x[i] for x in counts]) for i in (0, 1))
    count[hot] = totals["hot"][name]
    p = np.zeros(len(c))
    for s, (root, hot_tables) in enumerate(zip(totals["root"], totals["tables"])):
        live, tables, c0, t0 = (np.concatenate([x[4 * s + i] for x in samples]) for i in range(4))
        t = c.copy()
        t[c > 1] = live  # one customer or none has as many tables
        tables[hot] = hot_tables[name]
        below = _below(c0, t0, root)
        p += (c - DISCOUNT[1] * t + (STRENGTH[1] + DISCOUNT[1] * tables[u]) * below[w]) / (STRENGTH[1] + count[u])
    model, base = np.log10(p / len(totals["root"])), np.log10((count + 1.0) / (totals["N"] + totals["V"] + 1))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = lambda x: np.bincount(doc, x, len(sizes))
    return {"held_out": trains == 0, "n_tokens": sizes, "n_known": total(count[tokens] > 0).astype(np.int64), "train_tokens": np.full(len(sizes), totals["N"]), "base_score": total(base[tokens]), "score": total(model[entry])}


def _frequent(rows: DataFrame, size: int, most: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that a sample of the texts holds most often, sorted, and their places by frequency from 1 on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        n: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for t in byte_values(batch.column(0)):
                for w in t.translate(_LOWER).split():
                    n[w] += 1
        hashes = np.fromiter(map(xxh64_intdigest, n), np.uint64, len(n))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-size // sample)))) == 0).select("text")
    found = some.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most - 1).toArrow()
    hashes = np.asarray(found.column("word"), np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order.astype(np.uint64) + np.uint64(1)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD, named: int = NAMED, hot: int = HOT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row, learnt from the training rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learnt = rows.where(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 7 != 2)
    size = learnt.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # held-out texts have no say in anything
    shards = max(1, -(-size // shard))
    names = docs.sparkSession.sparkContext.broadcast(_frequent(learnt, size, named, SAMPLE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            data, asked = _block(ids.to_pylist(), [t for b in held for t in byte_values(b.column(1))], shards, names.value, hot)
            n = len(asked)
            return pa.RecordBatch.from_arrays(
                [pa.array(["d", *"q" * n]), pa.array([None, *(s for s, _ in asked)], pa.int64()), pa.array([part << 32 | seq] * (n + 1), pa.int64()), pa.array([data, *(x for _, x in asked)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * (n + 1)], pa.int32()), pa.StructArray.from_arrays([ids], ["id"]))],
                ["kind", "shard", "other", "data", "ids"],
            )

        held, held_bytes = [], 0
        for batch in in_slices(batches, "text", block):
            n = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if held and held_bytes + n > block:
                yield made(held)
                held, held_bytes, seq = [], 0, seq + 1
            held.append(batch)
            held_bytes += n
        if held:
            yield made(held)

    kind = docs.schema[id_col].dataType.simpleString()
    sent = settle(rows.mapInArrow(cut, f"kind string, shard long, other long, data binary, ids array<struct<id:{kind}>>"))

    def at_shards(messages: DataFrame, work: Callable, *more: object) -> DataFrame:
        return settle(messages.groupBy("shard").applyInPandas(lambda key, x: work(key, x, *more), _ROW))

    def hot_sums(messages: DataFrame, n: int) -> np.ndarray:
        out = np.zeros((n, hot), np.int64)
        for r in messages.where("kind = 'h'").groupBy("other").agg(F.sum("n").alias("n")).collect():  # a few for each hot word
            out.flat[r.other] = r.n
        return out

    def of(messages: DataFrame, *kinds: str) -> DataFrame:
        return messages.where(F.col("kind").isin(*kinds)).select(*_COLUMNS)

    asked = sent.where("kind = 'q'").select("kind", "shard", "other", "data")
    first = at_shards(asked, _first, shards, hot)
    of_hot, lone, tables = hot_sums(first, 3)
    sums = {r.other: r.n for r in first.where("kind = 'n'").groupBy("other").agg(F.sum("n").alias("n")).collect()}
    totals = {"N": sums.get(0, 0), "V": sums.get(1, 0) + int((of_hot > 0).sum()), "hot": of_hot, "root": [], "tables": []}
    sent_up, static, drawn, kept = of(first, "p"), None, of(first, "t"), []
    for sweep in range(BURN_IN + SAMPLES + 1):
        if sweep:
            drew = at_shards(of(first, "l").unionByName(of(drawn, "t")).unionByName(of(parent, "b")), _draw, sweep, root, lone + tables)
            (tables,) = hot_sums(drew, 1)
            drawn, sent_up = of(drew, "t"), of(drew, "v").unionByName(static)
        parent = at_shards(sent_up, _parent, sweep, totals["V"])
        static = of(parent, "R") if sweep == 0 else static
        told = {r.other: r.n for r in of(parent, "s").groupBy("other").agg(F.sum("n").alias("n")).collect()}
        root = (told.get(0, 0), told.get(1, 0), totals["V"])
        if sweep > BURN_IN:
            totals["root"].append(root)
            totals["tables"].append(lone + tables)
            kept.append(drawn.unionByName(of(parent, "r")))
    final = of(first, "o", "l", "i").unionByName(static)
    for x in kept:
        final = final.unionByName(x)
    sweeps = list(range(BURN_IN + 1, BURN_IN + SAMPLES + 1))
    answers = final.groupBy("shard").applyInPandas(lambda key, x: _answer(key, x, sweeps), _ROW)
    told = docs.sparkSession.sparkContext.broadcast(totals)

    def finish(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        by = [answers[answers["kind"] == k].sort_values("shard")["data"] for k in "ca"]
        ids = [x["id"] for x in own["ids"].iloc[0]]  # in structs, as an array with a null would be of floats
        return pd.DataFrame({"id": pd.Series(ids, dtype=object)} | _scored(own["data"].iloc[0], list(zip(*by)), told.value))

    own = sent.where("kind = 'd'").select("other", "data", "ids")
    given = of(first, "c").unionByName(answers).select("kind", "shard", "other", "data")
    out = own.groupBy("other").cogroup(given.groupBy("other")).applyInPandas(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
