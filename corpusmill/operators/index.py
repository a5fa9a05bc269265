"""An index of vectors by lists, and a search that is exact: it reads a list only if the triangle inequality can't rule it out.

Each vector is in the list of its nearest centroid, with its distance from it; a list knows the least and the greatest of these. A
query that is d away from a list's centroid is at least d - greatest, and least - d, away from all of its vectors. So the nearest lists
are read first, and then just those whose bound is within the k-th distance found. Distances are computed in numpy, block by block;
what counts in the end, the order and its ties, comes from the plain sum of squares.

Centroids go to the tasks in blocks of 32 MB, one after another, so any number of lists is possible. An index on disk lies in folders
of lists, of which a search reads those it needs. Vectors must have one length; rows whose vector is null, or holds a null or a number that
isn't finite, are in no list and are no queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import ivf_lists
from ..session import settled

#: Bytes of centroids in one broadcast; vectors and queries in one block; folders of an index on disk.
CENTROID_BYTES, VECTORS, QUERIES, SHELVES = 32 << 20, 8192, 512, 128
#: Distances from products of matrices are this near to the sum of squares, as a part of the squares themselves.
_NEAR = 1e-9


def distance(a: Column, b: Column) -> Column:
    """The square of the distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows with a vector of finite numbers, as doubles."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.withColumn(vector, x).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)))


def lists_of(vectors: DataFrame) -> int:
    """How many lists suit a table."""
    return vectors.agg(ivf_lists(F.count("*")).alias("n")).first().n


def first_centroids(vectors: DataFrame, lists: int, key: str, vector: str, seed: int = 0) -> DataFrame:
    """(list, x): the vectors of the smallest seeded digests of their keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    chosen = vectors.select(digest.alias("_d"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("x")).orderBy("_d", "_k").limit(lists)
    return chosen.select((F.row_number().over(Window.orderBy("_d", "_k")) - 1).alias("list"), "x")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squares of distances, row by row, by a product of matrices."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest rows of c to each row of x, and the square of the distance. Rows about as near are told apart plainly."""
    d = _squares(x, c)
    at = d.argmin(axis=1)
    slack = _NEAR * ((x * x).sum(axis=1) + (c * c).sum(axis=1).max())
    close = d <= d[np.arange(len(x)), at][:, None] + slack[:, None]
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        options = np.flatnonzero(close[i])
        at[i] = options[((c[options] - x[i]) ** 2).sum(axis=1).argmin()]
    return at, ((c[at] - x) ** 2).sum(axis=1)


def _blocks(centroids: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The centroids by number, in blocks of bounded bytes."""
    ids, rows, held = [], [], 0
    for r in centroids.orderBy("list").toLocalIterator():
        ids.append(r.list)
        rows.append(r.x)
        held += 8 * len(r.x)
        if held >= CENTROID_BYTES:
            yield np.array(ids, np.int32), np.array(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids, np.int32), np.array(rows)


def assign(vectors: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """vectors with `list`, that of the nearest centroid, the smaller of equally near ones, and `r`, the distance from it. Each block of
    centroids improves on what the ones before it found; vectors stay where they are."""
    sc = vectors.sparkSession.sparkContext
    out = usable(vectors, vector).withColumns({"list": F.lit(-1), "r": F.lit(float("inf"))})
    names = out.columns
    place, schema = names.index(vector), out.schema
    for ids, rows in _blocks(centroids):
        sent = sc.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, c = sent.value
            step = max(1, (8 << 20) // (8 * len(c)))
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    at, d = _nearest(_matrix(part.column(place)), c)
                    r, old = np.sqrt(d), part.column(len(names) - 1).to_numpy(zero_copy_only=False)
                    better = r < old
                    lists = np.where(better, ids[at], part.column(len(names) - 2).to_numpy(zero_copy_only=False)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(lists), pa.array(np.where(better, r, old))], names)

        out = out.mapInArrow(run, schema)
    return out


def train(vectors: DataFrame, key: str, vector: str, lists: int, rounds: int = 5, seed: int = 0) -> DataFrame:
    """(list, x): centroids after some rounds of means; a list that nothing is nearest to keeps its centroid. A task sums up the vectors
    of each list before anything is dealt out."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x, at = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for i in np.unique(at):
                own = x[at == i]
                held = total.setdefault(int(i), [0, 0.0])
                held[0] += len(own)
                held[1] = held[1] + own.sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([list(s) for _, s in total.values()], pa.list_(pa.float64()))], ["list", "n", "s"])

    centroids = settled(first_centroids(usable(vectors, vector), lists, key, vector, seed))
    for _ in range(rounds):
        each = assign(vectors, centroids, vector).select("list", vector).mapInArrow(sums, "list int, n long, s array<double>")
        each = each.select("list", "n", F.posexplode("s").alias("dim", "v")).groupBy("list", "dim").agg((F.sum("v") / F.sum("n")).alias("v"))
        means = each.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda z: z["v"]).alias("_x"))
        centroids = settled(centroids.join(means, "list", "left").select("list", F.coalesce("_x", "x").alias("x")))
    return centroids


def write(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Puts an index on disk: `vectors`, in folders by list, and `lists` with their centroids, sizes and distances; gives both back as read."""
    spark, shelf = vectors.sparkSession, F.pmod(F.col("list"), F.lit(SHELVES)).alias("shelf")
    rows = assign(vectors, centroids, vector).select(F.col(key).alias("key"), F.col(vector).alias("x"), "list", "r", shelf)
    rows.repartitionByRange("shelf", "list", "r").sortWithinPartitions("shelf", "list").write.partitionBy("shelf").parquet(f"{folder}/vectors")
    there = spark.read.schema(rows.schema).parquet(f"{folder}/vectors")
    lists = centroids.join(there.groupBy("list").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("greatest")), "list")
    lists.write.parquet(f"{folder}/lists")
    return there, spark.read.schema(lists.schema).parquet(f"{folder}/lists")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The vectors and the lists of an index."""
    return spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/lists")


def _asked(queries: DataFrame, lists: DataFrame, probes: int | None) -> DataFrame:
    """(query, list, d) of queries (query, q, t): the `probes` nearest lists that hold anything, with the distance of the centroid; or,
    without probes, all lists whose bound is within t."""
    sc = queries.sparkSession.sparkContext
    kind = queries.schema["query"].dataType.simpleString()
    parts = []
    for ids, rows in _blocks(lists.select("list", F.concat("x", F.array("least", "greatest")).alias("x"))):
        sent = sc.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, c = sent.value
            c, least, greatest = c[:, :-2], c[:, -2], c[:, -1]
            step = max(1, (8 << 20) // (8 * len(c)))
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    x = _matrix(part.column(1))
                    square = _squares(x, c)
                    d = np.sqrt(square)
                    if probes is None:
                        slack = _NEAR * (1 + (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None])
                        low = np.maximum(np.maximum(d - greatest, least - d), 0)
                        t = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                        row, at = np.nonzero(low <= np.sqrt(t) + np.sqrt(slack))
                    else:
                        at = np.argsort(d, axis=1, kind="stable")[:, :probes]
                        row, at = np.repeat(np.arange(len(x)), at.shape[1]), at.ravel()
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(ids[at]), pa.array(d[row, at])], ["query", "list", "d"])

        parts.append(queries.select("query", "q", "t").mapInArrow(run, f"query {kind}, list int, d double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query {kind}, list int, d double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if probes is not None and len(parts) > 1:  # each block has its nearest
        out = out.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy("d", "list"))).where(F.col("i") <= probes).drop("i")
    return out


def _found(vectors: DataFrame, lists: DataFrame, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, x, q): candidates for the k nearest, of each query in each block of a list that it asks for."""
    sizes = lists.select("list", F.ceil(F.col("n") / VECTORS).cast("int").alias("parts"))
    heads = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    shelves = [r.shelf for r in heads.select(F.pmod(F.col("list"), F.lit(SHELVES)).alias("shelf")).distinct().collect()]  # 128 at most
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = sizes.join(heads, "list")
    there = vectors.where(F.col("shelf").isin(shelves)).join(both, "list").select("list", deal("key", "parts").alias("part"), every("turns").alias("turn"), "key", "x")
    asking = asked.join(queries, "query").join(both, "list").select("list", every("parts").alias("part"), deal("query", "turns").alias("turn"), "query", "q")

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            x, q = (_matrix(t.column(name).combine_chunks()) for t, name in ((vectors, "x"), (queries, "q")))
            keys, ids = vectors.column("key").combine_chunks(), queries.column("query").combine_chunks()
            d = _squares(q, x)
            d[np.array(ids.to_pylist())[:, None] == np.array(keys.to_pylist())[None]] = np.inf  # nothing is its own neighbour
            edge = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.finfo(float).max)
            slack = _NEAR * (1 + (q * q).sum(axis=1) + (x * x).sum(axis=1).max())
            row, at = np.nonzero(d <= (edge + slack)[:, None])
            ok = np.isfinite(d[row, at])
            row, at = row[ok], at[ok]
            out = (ids.take(pa.array(row)), keys.take(pa.array(at)), vectors.column("x").combine_chunks().take(pa.array(at)), queries.column("q").combine_chunks().take(pa.array(row)))
            return pa.table(list(out), names=["query", "key", "x", "q"])
        return pa.table([queries.column("query").slice(0, 0), vectors.column("key").slice(0, 0), vectors.column("x").slice(0, 0), queries.column("q").slice(0, 0)], names=["query", "key", "x", "q"])

    kinds = f"query {queries.schema['query'].dataType.simpleString()}, key {vectors.schema['key'].dataType.simpleString()}, x array<double>, q array<double>"
    groups = ["list", "part", "turn"]
    return there.groupBy(*groups).cogroup(asking.groupBy(*groups)).applyInArrow(run, kinds)


def search(vectors: DataFrame, lists: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 1, probes: int = 1) -> DataFrame:
    """(query, rank, key, distance, read): the k nearest of all indexed vectors to each query, the smaller key first where they are equally
    near, with the square of the distance; `read` is the number of lists that the query has read. A query is no neighbour of its own key."""
    own = settled(usable(queries, vector).select(F.col(key).alias("query"), F.col(vector).alias("q")))
    near = settled(_asked(own.withColumn("t", F.lit(0.0)), lists, probes))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))

    def best(asked: DataFrame) -> DataFrame:
        return _found(vectors, lists, asked, own, k).select("query", "key", distance(F.col("x"), F.col("q")).alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)

    first = settled(best(near))
    edge = first.where(F.col("rank") == k).select("query", F.col("distance").alias("t"))
    reach = own.join(edge, "query", "left").select("query", "q", F.coalesce("t", F.lit(float("inf"))).alias("t"))
    more = settled(_asked(reach, lists, None).join(near.select("query", "list"), ["query", "list"], "left_anti"))
    every = first.select("query", "key", "distance").unionByName(best(more).select("query", "key", "distance"))
    read = near.select("query").unionAll(more.select("query")).groupBy("query").agg(F.count("*").alias("read"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).join(read, "query").select("query", "rank", F.col("key").alias(key), "distance", "read")
