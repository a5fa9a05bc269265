"""Contexts of the language model are whole words: every score is rebuilt word by word, by the plain recursion, from the tables drawn."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusmill.llm import queries, wordlm
from corpusmill.llm.hpylm import in_training, unpack


def words_of(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w.encode() for w in t.split(" ") if w] + [b""]


def pairs_of(text):
    w = words_of(text)
    return list(zip([b"", *w[:-1]], w))


def stage(rows, work, *more):
    frame = pd.DataFrame(rows, columns=wordlm._COLUMNS)
    return [tuple(r) for key, x in frame.groupby("shard") for r in work((key,), x, *more).itertuples(index=False)]


def of(rows, *kinds):
    return [r for r in rows if r[0] in kinds]


def hot_of(rows, n, hot):
    out = np.zeros((n, hot), np.int64)
    for r in of(rows, "h"):
        out.flat[r[2]] += r[4]
    return out


def seatings(docs, names, shards, hot, vocabulary):
    """The kept sweeps as {(code before, code): tables} of dishes of several customers, and {code: (customers, tables)} of the parent."""
    asked = []
    for at in range(0, len(docs), 7):
        part = docs[at : at + 7]
        asked += [("q", s, at, data, 0) for s, data in wordlm._block([d for d, _ in part], [(t or "").encode() for _, t in part], shards, names, hot)[1]]
    first = stage(asked, wordlm._first, shards, hot)
    dishes, rooms = {}, {}
    for r in of(first, "l"):
        room, _, _, _, hot_name, _ = unpack(r[3])
        codes = []
        for p in sorted((p for p in of(first, "p") if p[2] == r[1]), key=lambda p: p[1]):
            steps, far, _, live, _ = unpack(p[3])
            codes += wordlm._together(steps, far)[live > 0].tolist()
        (o,) = (unpack(o[3]) for o in of(first, "o") if o[1] == r[1])
        own = wordlm._together(*o[:2]).tolist()
        at = {int(k) - 1: c for c, k in zip(own, o[3]) if k} | {k: int(h) - 1 for k, h in enumerate(hot_name) if h}
        dishes[r[1]], rooms[r[1]] = codes, at
    static = {r[1]: [x.astype(np.int64) for x in unpack(r[3])] for r in of(first, "l")}
    _, lone, tables = hot_of(first, 3, hot)
    drawn, up, kept = of(first, "t"), of(first, "p"), []
    parent_names = {}
    for sweep in range(wordlm.BURN_IN + wordlm.SAMPLES + 1):
        if sweep:
            drew = stage(of(first, "l") + drawn + of(parent, "b"), wordlm._draw, sweep, root, lone + tables)  # noqa: F821
            (tables,) = hot_of(drew, 1, hot)
            drawn, up = of(drew, "t"), of(drew, "v") + same
        parent = stage(up, wordlm._parent, sweep, vocabulary)
        if not sweep:
            same = of(parent, "R")
            parent_names = {r[1]: wordlm._together(*unpack(r[3])[:2]).tolist() for r in same}
        root = tuple(sum(r[4] for r in of(parent, "s") if r[2] == k) for k in (0, 1)) + (vocabulary,)
        if sweep > wordlm.BURN_IN:
            live = {}
            for r in drawn:
                room, dish, c, *_ = static[r[1]]
                for u, w, n, t in zip(room, dish, c, unpack(r[3])[0]):
                    key = rooms[r[1]][int(u)], dishes[r[1]][int(w)]
                    assert key not in live  # a restaurant's dish is in one place
                    live[key] = int(n), int(t)
            roots = {w: (int(c), int(t)) for r in of(parent, "r") for w, c, t in zip(parent_names[r[1]], *unpack(r[3]))}
            kept.append((live, roots))
    return kept


def corpus():
    rng = random.Random(11)
    vocabulary = [f"{rng.choice('abcd')}{i}{rng.choice('xy')}" for i in range(70)] + ["The", "THE", "é", "ß"]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weights=[300 // (k + 1) + 1 for k in range(len(vocabulary))], k=rng.randrange(0, 60)))) for i in range(120)]
    return docs + [(200, None), (201, ""), (202, "never seen before " * 3), (203, "The the a0x never")]


@pytest.mark.parametrize("hot", [1, 6])
def test_score_is_that_of_the_tables(spark, hot):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    train = [t for d, t in docs if in_training(d)]
    size = sum(len((t or "").encode()) for t in train)
    shard = -(-size // 5)
    counts = Counter(p for t in train for p in pairs_of(t))
    of_word = Counter(w for t in train for w in words_of(t))
    learnt = frame.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select(F.col("doc_id").alias("id"), "text")
    names = wordlm._frequent(learnt, size, 40, wordlm.SAMPLE)  # other words go by their hashes
    code = {w: int(wordlm._codes(np.array([xxh64_intdigest(w)], np.uint64), names)[0]) if w else 0 for d, t in docs for w in words_of(t)}
    assert 0 < sum(c < 1 << 63 for c in code.values()) < len(code)
    samples = seatings(docs, names, -(-size // shard), hot, len(of_word))
    rules = []
    for live, parent in samples:
        assert {k: n for k, (n, _) in live.items()} == {(code[u], code[w]): n for (u, w), n in counts.items() if n > 1}
        assert all(1 <= t <= n for n, t in live.values())
        tables = {(u, w): live[code[u], code[w]][1] if n > 1 else 1 for (u, w), n in counts.items()}
        below, of_u = Counter(), Counter()
        for (u, w), t in tables.items():
            below[w] += t
            of_u[u] += t
        assert {code[w]: n for w, n in below.items()} == {w: c for w, (c, _) in parent.items()}  # tables are the parent's customers
        assert all(1 <= t <= c for c, t in parent.values())
        (d0, d1), (s0, s1) = wordlm.DISCOUNT, wordlm.STRENGTH
        all_c, all_t = (sum(x[i] for x in parent.values()) for i in (0, 1))

        def p(u, w, tables=tables, of_u=of_u, parent=parent, all_c=all_c, all_t=all_t):
            c, t = parent.get(code.get(w), (0, 0))
            base = (c - d0 * t + (s0 + d0 * all_t) / (len(of_word) + 1)) / (s0 + all_c)
            return (counts[u, w] - d1 * tables.get((u, w), 0) + (s1 + d1 * of_u[u]) * base) / (s1 + of_word[u])

        rules.append(p)
    for u in (b"", b"the", max(of_word), min(of_word, key=of_word.get), b"before"):
        for p in rules:
            assert abs(sum(p(u, w) for w in of_word) + p(u, b"no such word") - 1) < 1e-9
    n, v = sum(of_word.values()), len(of_word)
    got = {r.doc_id: r for r in wordlm.score(frame, block=900, shard=shard, named=40, hot=hot).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        r, w = got[d], words_of(text)
        want = sum(math.log10(sum(p(u, x) for p in rules) / len(rules)) for u, x in pairs_of(text))
        assert math.isclose(r.score, want, rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((of_word[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not in_training(d), len(w), sum(x in of_word for x in w), n)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_words_of_one_ending_are_told_apart(spark, tmp_path):
    """The query scores what follows a word by that word, not by how it ends."""
    learnt = [i for i in range(400) if in_training(i)]
    a, b = [i for i in range(400, 500) if not in_training(i)][:2]
    rows = [(i, "singing birds" if k % 2 else "walking dogs") for k, i in enumerate(learnt)] + [(a, "singing birds"), (b, "singing dogs")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op2_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[a] - got[b] > 1


def test_held_out_texts_have_no_say(spark):
    docs = corpus() + [(i, "only here " * 30) for i in range(300, 600) if not in_training(i)]
    train, held = ([x for x in docs if in_training(x[0]) == k] for k in (True, False))
    score = lambda rows: {r.doc_id: r.score for r in wordlm.score(spark.createDataFrame(rows, "doc_id long, text string"), block=700, shard=1500, named=40, hot=4).collect()}
    alone, together = score(train + held[:1]), score(train + held)
    assert len(together) == len(docs) and all(alone[i] == pytest.approx(together[i], abs=1e-9) for i in alone)


def test_little_or_nothing_to_learn_from(spark):
    held = next(i for i in range(99) if not in_training(i))
    (r,) = wordlm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.perplexity) == (3, 0, 0, 0.0, 0.0, 1.0)
    assert wordlm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = [(None, "no id"), (None, None), (1, "x y"), (1, "x y")]
    got = wordlm.score(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter([(None, 3), (None, 1), (1, 3), (1, 3)])
