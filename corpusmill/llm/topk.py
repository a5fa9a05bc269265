"""Exact top-k by integer inner product, with multi-resolution segment statistics.

A vector x is cut into segments of equal length; with the mean and the deviation of each, the distance of x and q is at least
sum(length * ((mean_x - mean_q)^2 + (dev_x - dev_q)^2)), and so their inner product is at most
sum(length * (mean_x * mean_q + dev_x * dev_q)). Bounds are taken from few segments to many; a candidate whose bound falls below
the k-th best found so far is dropped, and the survivors of the finest segments get their exact product.

Candidates are put into blocks once and stay where they are. Queries go round: as many as a bound on bytes allows are sent to all
tasks at a time, and a task takes its blocks one after another, keeping each query's k best, so what one block has shown prunes the
next. A task gives k rows a query, whose best are then taken by a ranking that limits before it shuffles. There are as many rounds as
the queries need; each is written before the next begins.

Components are floor(scale * x). Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id. Products are of vectors of one length only. Ties go to the smaller id; repeated ids of candidates count each, and the rows of a
repeated query id are searched each and ranked together (equal ones are searched once and counted as often as they are there, up to
k, as more can't be among the k best). Components may be as large as doubles go; products that don't fit a long are cut to its ends.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Segments of each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
#: Vectors in a block, bytes of a block at most, and bytes of queries that are sent at a time.
BLOCK, BLOCK_BYTES, ROUND_BYTES = 4096, 8 << 20, 32 << 20


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each vector's segments, weighted so that a bound is an inner product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        part, weight = x[:, a:b], np.sqrt(b - a)
        out += part.mean(axis=1) * weight, part.std(axis=1) * weight
    return np.stack(out, axis=1)


class Best:
    """The k best candidates of each of some queries of one length, over all blocks of candidates that it is shown."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.stats = [statistics(x, s) for s in RESOLUTIONS]
        self.norms = np.linalg.norm(x, axis=1)
        self.largest = float(np.abs(x).max(initial=0))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), in order

    def _add(self, i: int, scores: list[int], ids: list[int]) -> None:
        self.found[i] = sorted([*self.found[i], *((-s, c) for s, c in zip(scores, ids))])[: self.k]

    def show(self, ids: np.ndarray, x: np.ndarray) -> None:
        if self.largest * float(np.abs(x).max(initial=0)) * x.shape[1] >= 2**53:
            whole = [[int(v) for v in row] for row in x.tolist()]  # whole numbers without limit
            for i, row in enumerate(self.x.tolist()):
                row = [int(v) for v in row]
                own = [n for n, c in enumerate(ids.tolist()) if c != self.ids[i]]
                self._add(i, [sum(a * b for a, b in zip(row, whole[n])) for n in own], [int(ids[n]) for n in own])
            return
        stats = [statistics(x, s) for s in RESOLUTIONS]
        slack = 1e-9 * (1 + self.norms * np.linalg.norm(x, axis=1).max(initial=0))
        coarse = self.stats[0] @ stats[0].T
        for i in range(len(self.ids)):
            bound, held = coarse[i], self.found[i]
            # the k-th best so far, of those before and of those here that look best, is what others must reach
            likely = np.argpartition(-bound, min(len(bound) - 1, 4 * self.k))[: 4 * self.k + 1]
            likely = likely[ids[likely] != self.ids[i]]
            exact = np.sort(np.concatenate([x[likely] @ self.x[i], [-s for s, _ in held]]))
            least = exact[-self.k] if len(exact) >= self.k else -np.inf
            left = np.flatnonzero(bound >= least - slack[i])
            for own, theirs in zip(self.stats[1:], stats[1:]):
                left = left[theirs[left] @ own[i] >= least - slack[i]]
            left = left[ids[left] != self.ids[i]]
            score = x[left] @ self.x[i]
            top = np.lexsort((ids[left], -score))[: self.k]
            self._add(i, score[top].astype(np.int64).tolist(), ids[left[top]].tolist())

    def rows(self, times: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, candidate, score), those of a query as often as `times` has it."""
        return [(int(q), c, min(max(-s, -(2**63)), 2**63 - 1)) for q, n, found in zip(self.ids, times, self.found) for s, c in found for _ in range(n)]


def _blocks(rows: DataFrame, scale: float, most: int) -> DataFrame:
    """(d, n, ids, times, data): blocks of up to `most` vectors of length d that take part, as doubles, of rows (id, x, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def made(d: int) -> pa.RecordBatch:
            ids, times, xs = zip(*held.pop(d))
            columns = [pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in ((ids, np.int64), (times, np.int64), (xs, np.float64)))]
            return pa.RecordBatch.from_arrays(columns, ["d", "n", "ids", "times", "data"])

        for batch in batches:
            for i, x, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                v = x.values
                if i is None or v is None or not len(v) or v.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    held.setdefault(len(x), []).append((i, times, x))
                    if len(held[len(x)]) == max(1, min(most, BLOCK_BYTES // (8 * len(x)))):
                        yield made(len(x))
        for d in list(held):
            yield made(d)

    return rows.mapInArrow(run, "d int, n int, ids binary, times binary, data binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k highest products of each row that `queries` picks with every row but those of its id."""
    spark = vectors.sparkSession
    named = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")]
    n, n_queries = vectors.agg(F.count("*"), F.count_if(queries)).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # blocks are dealt to tasks by number, as the sizes of rows tell nothing of the work in them
    most = max(64, min(BLOCK, -(-n // tasks)))
    given = settle(_blocks(vectors.select(*named, F.lit(1).cast("long").alias("times")), scale, most).repartition(max(tasks, -(-n // (16 * BLOCK)))))
    asked = vectors.where(queries).select(*named).groupBy("id", "x").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    asked = settle(_blocks(asked.coalesce(max(1, -(-n_queries // BLOCK))), scale, BLOCK).withColumn("number", F.monotonically_increasing_id()))
    rounds, held = [[]], 0
    for r in asked.select("number", (F.col("n") * F.col("d") * 8).alias("size")).orderBy("number").collect():  # a row for each 4,096 queries
        if rounds[-1] and held + r["size"] > round_bytes:
            rounds, held = [*rounds, []], 0
        rounds[-1].append(r.number)
        held += r["size"]

    def of_round(numbers: list[int]) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r.d, bytes(r.ids), bytes(r.times), bytes(r.data)) for r in asked.where(F.col("number").isin(numbers)).collect()])  # round_bytes, or one block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = [(d, Best(np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, d), k), np.frombuffer(times, np.int64)) for d, ids, times, data in sent.value]
            for batch in batches:
                for d, ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    for own, best, _ in every:
                        if own == d:
                            best.show(np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, d))
            for _, best, times in every:
                rows = best.rows(times)
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 50_000])], ["query_id", "id", "score"])

        found = given.select("d", "ids", "data").mapInArrow(run, "query_id long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    if len(rounds) == 1:
        out = of_round(rounds[0])
    else:  # rows of one query id may be in several rounds
        every = [settle(of_round(numbers)).drop("rank") for numbers in rounds]
        out = every[0]
        for more in every[1:]:
            out = out.unionByName(more)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
