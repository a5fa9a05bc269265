"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = 1 / (1 + exp(-(threshold_k - x.w))): one weight vector serves every threshold, the thresholds are kept in order.
x holds the distinct words of a text and their first and last 4 and 5 bytes, as 64-bit hashes; only features that lean clearly to
one side in the sample have a weight. The output is the probability of each grade and the expected one.

The model is fitted on a bounded sample of the labelled rows (`sample` rows and `sample_bytes` of text, the smallest hashes of
their ids; of several texts of an id the least), everything else reads all rows. Near copies among the sample (Jaccard of features 0.8 or more, of one grade) count once; the model tells how many
rows it was fitted on. Grades are 0, 1, 2 ...; a label of only 0 and 1 is first spread to three
grades: of the rows labelled 1, those with more indicative words than the median, measured by the root of how many words a text
has, are grade 2. After the fit the thresholds move together, to where the lowest grade is told apart best in the sample.

Null and empty texts have no features and get the grade of the thresholds alone, which is the lowest when most rows are of it.
Null ids or labels are not used for fitting. Without labelled rows of two grades every row gets severity 0 and nothing is
rejected. Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, in_slices

#: Labelled rows, and bytes of text, that the model is fitted on, at most.
SAMPLE, SAMPLE_BYTES = 8000, 256 << 20
#: Words remembered by a worker, a bound on memory alone.
REMEMBERED = 300_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def distinct_words(data: bytes) -> set[bytes]:
    return set(_WORDS.findall(data.lower()))


def features(word: bytes) -> list[int]:
    from xxhash import xxh64_intdigest as h

    out = [h(word, 1)]
    for k in (4, 5):
        if len(word) > k:
            out += h(word[:k], 2 * k), h(word[-k:], 2 * k + 1)
    return out


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    #: Rows that it was fitted on.
    fitted: int = 0

    def known(self) -> dict[bytes, float]:
        """Remembers the summed weight of words."""
        return _Known(self.weights)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Rows of P(grade = k)."""
        if not self.thresholds:
            return np.ones((len(scores), 1))
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)


class _Known(dict):
    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        out = sum(get(f, 0.0) for f in features(word))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


def _without_copies(rows: list[np.ndarray], grades: list[int], least: float = 0.8, sketch: int = 64) -> list[int]:
    """One of each group of near copies: a row goes if its features and those of one earlier kept row of its grade have a Jaccard of
    `least` or more. Sketches of smallest hashes find the rows to compare, the features themselves decide."""
    if not rows:
        return []
    odd = np.random.default_rng(0).integers(0, 2**63, sketch, np.uint64) * np.uint64(2) + np.uint64(1)
    signs = np.zeros((len(rows), sketch), np.uint32)
    for i, row in enumerate(rows):
        if len(row):
            signs[i] = ((row[:, None] * odd) >> np.uint64(32)).min(axis=0)
    likely = (least - 0.2) * sketch  # four deviations of a sketch of 64 below `least`
    kept: dict[int, list[int]] = {}
    for i, row in enumerate(rows):
        of_grade = kept.setdefault(grades[i], [])
        agree = (signs[of_grade] == signs[i]).sum(axis=1) if of_grade else np.empty(0)
        for j in np.flatnonzero(agree >= likely):
            other = rows[of_grade[j]]
            both = len(np.intersect1d(row, other, assume_unique=True))
            if both >= least * (len(row) + len(other) - both):
                break
        else:
            of_grade.append(i)
    return sorted(i for x in kept.values() for i in x)


def _boundary(scores: np.ndarray, clean: np.ndarray, fitted: float, cost: float = 10.0) -> float:
    """The score that separates the lowest grade best: the share of the others above it less `cost` times that of the lowest, midway
    of the widest gap that does so; the fitted threshold if no score does. A ridge draws scores together, and the fitted threshold with
    them. Where most rows are of the lowest grade, a text without features stays so."""
    order = np.argsort(scores, kind="stable")
    s, low = scores[order], clean[order]
    gain = np.cumsum(low) * cost / max(low.sum(), 1) - np.cumsum(~low) / max((~low).sum(), 1)  # up to a constant, below each place
    edges = np.flatnonzero(np.diff(s) > 1e-9)
    middles = (s[edges] + s[edges + 1]) / 2
    if low.mean() >= 0.5:
        edges, middles = edges[middles > 0], middles[middles > 0]
    if not len(edges) or gain[edges].max() <= gain[-1] + 1e-12:
        return fitted
    best = edges[gain[edges] >= gain[edges].max() - 1e-12]
    widest = best[np.argmax(s[best + 1] - s[best])]
    return float((s[widest] + s[widest + 1]) / 2)


def fit(texts: list[bytes], grades: list[int], least_docs: int = 5, least_z: float = 4.0, steps: int = 400, ridge: float = 3e-4) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows."""
    pairs = sorted(zip(texts, grades))
    rows = [np.unique(np.array([x for w in distinct_words(text) for x in features(w)], np.uint64)) for text, _ in pairs]
    keep = _without_copies(rows, [g for _, g in pairs])
    rows, y = [rows[i] for i in keep], [pairs[i][1] for i in keep]
    y = np.array(y, np.int64)
    if len(np.unique(y)) < 2:
        return Model()
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, col = np.unique(np.concatenate(rows), return_inverse=True)
    high = y > 0
    a, b = np.bincount(col, high[doc], len(names)), np.bincount(col, ~high[doc], len(names))
    p = a.sum() / max(a.sum() + b.sum(), 1) if not high.any() else high.mean()
    z = (a - (a + b) * p) / np.sqrt((a + b) * p * (1 - p) + 1e-9)
    chosen = (a + b >= least_docs) & (np.abs(z) >= least_z)
    place = np.cumsum(chosen) - 1
    use = chosen[col]
    doc, col, names, leaning = doc[use], place[col[use]], names[chosen], (z > 0)[chosen]
    if y.max() == 1:  # spread a yes/no label by how much of the text speaks for it, not by how long the text is
        n = np.bincount(doc, leaning[col], len(rows)) / np.sqrt([max(len(r), 1) for r in rows])
        y = np.where(high & (n > np.median(n[high])), 2, y)
    levels, y = np.unique(y, return_inverse=True)
    k = len(levels) - 1
    share = np.cumsum(np.bincount(y))[:-1] / len(y)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, cut = params[: len(names)], params[len(names) :]
        thresholds = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
        score = np.bincount(doc, w[col], len(rows))
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-np.clip(edges[y + 1] - score, -500, 500))), 1 / (1 + np.exp(-np.clip(edges[y] - score, -500, 500)))
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g_score = (d_hi - d_lo) / len(y)
        g_threshold = np.array([(d_lo[y == j + 1].sum() - d_hi[y == j].sum()) / len(y) for j in range(k)])
        g_cut = np.concatenate([[g_threshold.sum()], [g_threshold[j:].sum() * np.exp(cut[j]) for j in range(1, k)]])
        g = np.concatenate([np.bincount(col, g_score[doc], len(names)) + ridge * w, g_cut])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w, cut = params[: len(names)], params[len(names) :]
    thresholds = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
    score = np.bincount(doc, w[col], len(rows))
    thresholds += _boundary(score, y == 0, thresholds[0]) - thresholds[0]
    # a ridge draws scores together too: they are stretched as far as makes the sample likelier
    stretch = max((1.0, 1.5, 2.0, 3.0, 4.0), key=lambda a: np.log(np.maximum(Model(thresholds=list(a * thresholds)).probabilities(a * score)[np.arange(len(y)), y], 1e-12)).sum())
    w, thresholds = w * stretch, thresholds * stretch
    return Model({int(n): float(x) for n, x in zip(names, w)}, [float(x) for x in thresholds], len(rows))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from `sample` labelled rows and `sample_bytes` of their texts at most. It is fitted in one task; only it comes to the
    driver."""
    picked = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("long").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    picked = picked.groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # one text for an id, however often it is there, and in the order of the hashes as many as the bound on bytes allows
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("grade").alias("grade"))
    held = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))  # of `sample` rows
    rows = rows.withColumn("held", held).where(F.col("held") <= sample_bytes).select("text", "grade")

    def run(batches):
        texts, grades = [], []
        for batch in batches:
            texts += byte_values(batch.column(0))
            grades += batch.column(1).to_pylist()
        model = fit(texts, grades)
        names = list(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([n - (1 << 64) if n >> 63 else n for n in names] + [None] * (len(model.thresholds) + 1), pa.int64()), pa.array([*model.weights.values(), *model.thresholds, None], pa.float64()), pa.array([model.fitted] * (len(names) + len(model.thresholds) + 1), pa.int64())], ["f", "x", "fitted"])

    got = rows.repartition(1).mapInArrow(run, "f long, x double, fitted long").collect()
    return Model({r.f & (1 << 64) - 1: r.x for r in got if r.f is not None}, sorted(r.x for r in got if r.f is None and r.x is not None), max((r.fitted for r in got), default=0))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with severity (expected grade, double), grade (the likeliest, int) and p_clean (of grade 0); names that are taken are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = ["severity", "grade", "p_clean"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in added])
    schema = T.StructType([*base.schema, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_clean", T.DoubleType())])
    at, names = base.columns.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = model.known()
        for batch in in_slices(batches, names[at]):
            texts = byte_values(batch.column(at))
            p = model.probabilities(np.array([sum(map(known.__getitem__, distinct_words(t))) for t in texts], np.float64))
            out = [pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names)

    return base.mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame, reject: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() by a model trained on the labels, and rejected: grade 0 is less likely than `reject`."""
    out = score(docs, train(docs, labels, id_col, text_col, sample=sample), text_col)
    return out.withColumn("rejected", F.col("p_clean") < reject)
