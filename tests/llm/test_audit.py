"""The audit of filters against counting in every order."""

import random
from fractions import Fraction
from itertools import permutations

from corpusmill.llm import audit

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, part, text in docs:
        text = text or ""
        w = words(text)
        fails.append({
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and any(e is not None and e < d and (x or "") == text for e, _, x in docs),
        })
    out = {}
    for part in {p or "" for _, p, _ in docs}:
        rows = [(d, f) for (d, p, _), f in zip(docs, fails) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                total[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f[x] for _, f in rows) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def result(frame):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in frame.collect()}


def test_against_counting(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ÀB", "C", "#", "é e"]
    texts = [rng.choice(WHITE).join(rng.choices(vocabulary, k=rng.choice([0, 1, 20, 90, 100, 140, 400]))) for _ in range(60)] + [None, "", "   ", "AAAA BBBB", "x" * 2_000_000]
    docs = [(rng.choice([None, *range(70)]), rng.choice(["en", "de", "", None]), rng.choice(texts)) for _ in range(300)]
    docs += docs[:20]
    labels = [(rng.choice([None, *range(90)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, lang string, text string, MASK string")
    got = result(audit.audit(frame, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, n int")))
    assert got == plain(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], "doc_id long, lang string, text string"), none).count() == 0
    got = result(audit.audit(spark.createDataFrame([(1, "en", "a b")], "doc_id long, lang string, text string"), none))
    assert len(got) == 600 and got["en", "BCDAE", 4] == [0, 1, 0, 1, 0, 0, 120]


def test_polynomial():
    counts = [random.Random(1).randrange(50) for _ in range(32)]
    p = audit.removal_polynomial(counts)
    for s in range(32):
        assert audit.at_corner(p, s) == sum(n for m, n in enumerate(counts) if m & s)
    for i in range(5):
        assert audit.shapley(p, i) == sum(Fraction(n, m.bit_count()) for m, n in enumerate(counts) if m >> i & 1)
    assert sum(audit.shapley(p, i) for i in range(5)) == audit.at_corner(p, 31)
