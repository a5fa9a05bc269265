"""HyperMinHash near-duplicates against comparing all sets."""

import random

import numpy as np

from corpusmill.llm import hyperminhash as hm


def plain(docs):
    sets = []
    for _, text in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append(frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def family(rng, words, copies, most):
    """Copies of a text with up to `most` words changed."""
    text = rng.choices(words, k=150)
    out = [" ".join(text)]
    for _ in range(copies):
        t = list(text)
        for _ in range(rng.randrange(most + 1)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = family(rng, words, 250, 9) + family(rng, words, 60, 6)
    texts += [" ".join(rng.choices(words, k=k)) for k in (1, 2, 3, 4, 8, 9, 10, 30, 80) for _ in range(4)]
    for k in (7, 8, 9, 10, 12, 15, 20, 40):  # short texts, and the same with one end
        t = rng.choices(words, k=k)
        texts += [" ".join(t), " ".join(t[:-1]), " ".join(t).upper(), "\t".join(t) + "\n", " ".join([*t, "end"])]
    texts += [None, "", " \n", "a", "A", "　"] + texts[:30]
    long = rng.choices(words, k=60_000)
    texts += [" ".join(long), " ".join(long[:-3000]), " ".join(long[:50_000])]
    docs = [(None if i % 40 == 0 else i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    docs += docs[:5]
    frame = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, S string, n int")
    got = hm.near_duplicates(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs)


def test_chain(spark):
    """Each text is linked with the next only."""
    words = [f"w{i}" for i in range(400)]
    docs = [(100 - i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in hm.near_duplicates(frame).collect()), key=str) == plain(docs)


def test_empty(spark):
    assert hm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = hm.near_duplicates(spark.createDataFrame([(2, None), (1, ""), (None, " ")], "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_registers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 20_000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        want = np.full(256, 0xFFFF, np.uint16)
        for b in range(256):
            inside = [int(x) & ((1 << 56) - 1) for x in h if int(x) >> 56 == b]
            if inside:
                bits = f"{min(inside):056b}"
                zeros = len(bits) - len(bits.lstrip("0"))
                want[b] = zeros << 10 | int(bits[zeros + 1 :].ljust(60, "0")[:10], 2)
        assert (hm.registers(h) == want).all()


def test_estimates():
    """Within five deviations for related sets, and near zero for unrelated ones however large."""
    rng = np.random.default_rng(2)
    for size, share in ((100, 0.9), (1000, 0.85), (50_000, 0.5), (50_000, 0.0)):
        a = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        b = np.concatenate([a[: int(size * share)], rng.integers(0, 1 << 64, size - int(size * share), dtype=np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got, n = hm.estimates(hm.registers(np.unique(a))[None], hm.registers(np.unique(b))[None], np.array([size]), np.array([size]))
        assert abs(got[0] - j) <= 5 * np.sqrt(max(j * (1 - j), 0.01) / n[0])


def test_bands():
    """A pair at the threshold shares a band; the loss is far below what a thousand pairs would show."""
    rng = np.random.default_rng(3)
    for size in (20, 60, 600):
        missed = 0
        for _ in range(300):
            a = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            cut = int(size * 0.85 / 1)  # b is a part of a: intersection / union = 0.85
            keys = hm.band_keys(hm.densified(np.array([hm.registers(np.unique(a)), hm.registers(np.unique(a[:cut]))])))
            missed += not (keys[0] == keys[1]).any()
        assert missed == 0
