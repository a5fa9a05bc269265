"""The score of every text, rebuilt word by word from the kept seatings by the plain recursion."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from xxhash import xxh64_intdigest

from corpusmill.llm import hpylm


def words_of(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w.encode() for w in t.split(" ") if w] + [hpylm._END]


def contexts(words):
    """The last two bytes of the word before; nothing at the beginning."""
    return [0] + [int.from_bytes(w[-2:], "big") for w in words[:-1]]


def seatings(docs):
    """Per kept sample: (customers, tables) of words in each context of two bytes, one byte, none."""
    _, asked, (seen, n) = hpylm._block([d for d, _ in docs], [(t or "").encode() for _, t in docs], 1)
    by_context = np.zeros(65536, np.int64)
    by_context[seen] = n
    state = hpylm._seat((0,), pd.DataFrame([(0, 0, data) for _, data in asked], columns=["block", "shard", "data"]), by_context, 1)
    names, per_word, context, c, *rest = (x.tolist() for x in hpylm.unpack(state["data"].iloc[0]))
    entries = [(w, u) for w, k in zip(names, per_word) for u in [None] * k]
    entries = [(w, u) for (w, _), u in zip(entries, context)]
    place = {w: i for i, w in enumerate(names)}
    pairs = sorted({(place[w], u & 0xFF) for w, u in entries})
    samples = []
    for s in range(hpylm.SAMPLES):
        t2, c1, t1, c0, t0 = rest[5 * s : 5 * s + 5]
        levels = [{(w, 0): x for w, x in zip(names, zip(c0, t0))}, {(names[i], u): x for (i, u), x in zip(pairs, zip(c1, t1))}, {e: x for e, x in zip(entries, zip(c, t2))}]
        samples.append(levels)
    return names, samples


def predictive(levels, v):
    """p(word hash, context), by the rule of the model."""
    totals = [defaultdict(lambda: [0, 0]) for _ in levels]
    for level, total in zip(levels, totals):
        for (_, u), (c, t) in level.items():
            total[u][0] += c
            total[u][1] += t

    def p(w, u, k=2):
        at = (0, u & 0xFF, u)[k]
        below = 1 / (v + 1) if k == 0 else p(w, u, k - 1)
        c, t = levels[k].get((w, at), (0, 0))
        customers, tables = totals[k].get(at, (0, 0))
        d, strength = hpylm.DISCOUNT[k], hpylm.STRENGTH[k]
        return ((c - d * t if c else 0) + (strength + d * tables) * below) / (strength + customers)

    return p


def test_score_is_that_of_the_seatings(spark):
    rng = random.Random(11)
    vocabulary = [f"{rng.choice('abcd')}{i}{rng.choice('xyz')}" for i in range(60)] + ["The", "THE", "é", "ß"]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (202, "never seen before " * 3)]
    names, samples = seatings(docs)
    rules = [predictive(levels, len(names)) for levels in samples]
    for u in (0, contexts([b"the", b"x"])[1], contexts([b"a0x", b"x"])[1], 0xFFFF):
        for p in rules:
            assert abs(sum(p(w, u) for w in names) + p(None, u) - 1) < 1e-9  # every word, and one for all that were never seen
    # an entry's customers are the tokens, a level's customers the tables below it, tables between one and the customers
    for levels in samples:
        below = defaultdict(int)
        for (w, u), (c, t) in levels[2].items():
            assert 1 <= t <= c
            below[w, u & 0xFF] += t
        assert {k: c for k, (c, _) in levels[1].items()} == below
        assert sum(c for c, _ in levels[0].values()) == sum(t for _, t in levels[1].values())
    trained = sum(len(words_of(t)) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2)
    assert sum(c for c, _ in samples[0][2].values()) == trained
    got = {r.doc_id: r.score for r in hpylm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        w = words_of(text)
        want = sum(math.log10(sum(p(xxh64_intdigest(x), u) for p in rules) / len(rules)) for x, u in zip(w, contexts(w)))
        assert math.isclose(got[d], want, rel_tol=1e-9)
