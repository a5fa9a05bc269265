"""Near-duplicates by HyperMinHash: compressed registers are banded, estimates corrected for collisions choose what is confirmed.

A document's set are its distinct shingles of three words, lower case, as 64-bit digests; of fewer words, the whole sequence is one.
The first 8 bits of a digest name one of 256 buckets; a bucket's least digest is kept as its count of leading zeros and the 10 bits
after the leading one: a register of 16 bits. Registers of empty buckets are borrowed, from the first full bucket in an order of the
bucket's own, so that any registers agree with about the sets' Jaccard similarity. 36 bands of 7 registers are joined: a pair at just
85 % shares no band in less than one of a million cases, a pair at 90 % in one of ten billion.

Equal sets are one row throughout. In the groups that bands make no pairs are listed:
1. The set whose groups are fullest leads a group: in a family of copies, the original. Of the leaders that are half alike by estimate, a
   set goes to that of the fullest groups, so that a family comes together at one. Estimate: of the buckets that either fills, the
   share of equal registers, less what sets of these sizes agree on by chance.
2. Texts are dealt out to their leaders, hot leaders to many tasks, and compared as full sets. What a set lacks of its leader's set, and
   has besides, is kept.
3. Sets of one leader that are not linked yet are compared, in blocks, by these differences; they give the exact intersection.
4. Sets of one band but of different leaders and components are listed if their sizes, 256 bits of the registers, and then the estimate
   allow a link but for five deviations; their full sets decide.

Links are confirmed on full sets. Null and empty texts have an empty set, are linked with nothing, and are each their own component.
Repeated rows share a set and so a component. Rows without an id take part in linking, but give no component its id; where no row has
one, it is null, and no such row is kept. An empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, in_slices, row_key, settle
from .simhash import components, shingle_hashes

SHINGLE, SEED, PERCENT = 3, 12, 85
BUCKET_BITS, MANTISSA_BITS = 8, 10
BAND_ROWS, BANDS = 7, 36
DEVIATIONS = 5
#: How alike a set and its leader are; sets of a leader in one task, and in a block.
ALIKE, STAR, BLOCK = 0.5, 1000, 512
_BUCKETS, _REST, _EMPTY = 1 << BUCKET_BITS, 64 - BUCKET_BITS, 0xFFFF
_J = PERCENT / 100


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number of 64 bits spread over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The order in which an empty bucket looks for a full one: row by bucket.
_LENDERS = np.argsort(_mixed(np.arange(1, _BUCKETS**2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(_BUCKETS, _BUCKETS), axis=1, kind="stable")


def shingle_set(data: bytes) -> np.ndarray:
    """The distinct digests of a text, in order."""
    return np.unique(np.array(shingle_hashes(data, SHINGLE, SEED), np.uint64))


def registers(found: np.ndarray) -> np.ndarray:
    """The register of every bucket from ordered digests; that of an empty one has all bits set."""
    starts = np.searchsorted(found, np.arange(_BUCKETS, dtype=np.uint64) << np.uint64(_REST))
    full = np.diff(np.append(starts, len(found))) > 0
    rest = found[starts[full]] & np.uint64((1 << _REST) - 1)
    high, low = rest >> np.uint64(28), rest & np.uint64((1 << 28) - 1)  # halves, which a double holds exactly
    length = np.where(high > 0, np.frexp(high.astype(float))[1] + 28, np.frexp(low.astype(float))[1]).astype(np.uint64)
    after = (rest << (np.uint64(_REST) - length)) & np.uint64((1 << _REST - 1) - 1)  # without the leading one
    out = np.full(_BUCKETS, _EMPTY, np.uint16)
    out[full] = ((np.uint64(_REST) - length) << np.uint64(MANTISSA_BITS)) | (after >> np.uint64(_REST - 1 - MANTISSA_BITS))
    return out


def densified(x: np.ndarray) -> np.ndarray:
    """Registers by row, where empty buckets borrow; rows without any full bucket stay empty."""
    out = x.copy()
    for row in np.flatnonzero((x == _EMPTY).any(axis=1) & (x != _EMPTY).any(axis=1)):
        empty = np.flatnonzero(x[row] == _EMPTY)
        order = _LENDERS[empty]
        out[row, empty] = x[row, order[np.arange(len(empty)), (x[row] != _EMPTY)[order].argmax(axis=1)]]
    return out


def band_keys(dense: np.ndarray) -> np.ndarray:
    """A key for each band, by row."""
    with np.errstate(over="ignore"):
        key = np.full((len(dense), BANDS), 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
        cells = dense[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        for i in range(BAND_ROWS):
            key = _mixed(key + cells[:, :, i] + np.uint64(1))
    return key


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many registers two unrelated sets of these sizes are expected to agree in: over cells of equal registers, the product of
    the probabilities that a bucket's least digest falls there. A sixteenth of the cells of each count of zeros is taken together."""
    parts = 16
    lz = np.arange(_REST)[:, None]
    edges = np.concatenate([np.ldexp(1 + np.arange(parts) / parts, -lz - 1).ravel()[:, None], np.ldexp(1 + np.arange(1, parts + 1) / parts, -lz - 1).ravel()[:, None]], axis=1) / _BUCKETS
    inside = lambda k: np.exp(k[:, None] * np.log1p(-edges[:, 0])) - np.exp(k[:, None] * np.log1p(-edges[:, 1]))
    return _BUCKETS * (inside(n.astype(float)) * inside(m.astype(float))).sum(axis=1) / ((1 << MANTISSA_BITS) / parts)


def estimates(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities from registers by row, and how many buckets they rest on."""
    either = ((x != _EMPTY) | (y != _EMPTY)).sum(axis=1)
    equal = ((x == y) & (x != _EMPTY)).sum(axis=1)
    chance = np.minimum(chance_matches(n, m), either / 2)
    return (equal - chance) / np.maximum(either - chance, 0.5), either


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether pairs may be linked, by sizes and estimate."""
    j, either = estimates(x, y, n, m)
    sizes = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    return sizes & (j >= _J - DEVIATIONS * np.sqrt(_J * (1 - _J) / np.maximum(either, 1)))


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, _BUCKETS)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, s, n, regs, f0..f3) of every row: its key, its set's digest, size and registers, and a bit of each register."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                digests, sizes, regs = [], [], []
                for data in byte_values(part.column(3)):
                    found = shingle_set(data)
                    digests.append(xxh3_128_digest(found.tobytes()))
                    sizes.append(len(found))
                    regs.append(registers(found))
                x = np.array(regs)
                bits = np.packbits(densified(x) & 1, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), *(pa.array(bits[:, i].copy()) for i in range(4))], ["id", "a", "b", "s", "n", "regs", "f0", "f1", "f2", "f3"])

    key = row_key("id", "text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", key["a"].alias("a"), key["b"].alias("b"), "text")
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, a long, b long, s binary, n long, regs binary, f0 long, f1 long, f2 long, f3 long")


def bands(sets: DataFrame) -> DataFrame:
    """(k, s): the keys of the bands of sets (s, regs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                keys = band_keys(densified(_table(part.column(1)))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], ["k", "s"])

    return sets.select("s", "regs").mapInArrow(run, "k long, s binary")


def estimated(pairs: DataFrame, sets: DataFrame, least: float | None = None) -> DataFrame:
    """The pairs (x, y) of digests that may be linked; or those of an estimate of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [*map(_table, batch.columns[2:4]), *(c.to_numpy() for c in batch.columns[4:])]
                ok = may_link(*sides) if least is None else estimates(*sides)[0] >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(ok))

    side = lambda k: sets.select(F.col("s").alias(k), F.col("regs").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "rx", "ry", "nx", "ny").mapInArrow(run, "x binary, y binary")


_COMPARED = "y binary, x binary, ny long, nx long, same long, lacks array<long>, besides array<long>"


def compared(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, differences: bool) -> DataFrame:
    """Full sets of pairs (x, y): sizes, intersection, and what x lacks of y and has besides, if that is asked for.

    A text is dealt out by its key, and the few that are asked for then to their y. Rows of one y are dealt to a task for each 1,000,
    each with y's own text before them, so a task holds one set at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, base = None, None
        for batch in in_slices(batches, "text"):
            out = []
            for y, x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_values(batch.column(2))):
                if x == y:
                    lead, base = y, shingle_set(text)
                elif y == lead:
                    own = shingle_set(text)
                    both = np.isin(own, base, assume_unique=True)
                    gone = base[~np.isin(base, own, assume_unique=True)] if differences else base[:0]
                    out.append((y, x, len(base), len(own), int(both.sum()), gone.view(np.int64), own[~both].view(np.int64) if differences else gone))
                else:
                    raise ValueError("a text came before that of its leader")
            if out:
                kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in _COMPARED.split(", ")])

    parts = pairs.groupBy("y").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.select("x", "y").join(parts, "y").select("y", F.col("x").alias("s"), F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))
    leaders = parts.select("y", F.col("y").alias("s"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = members.unionByName(leaders).join(sets.select("s", "a", "b"), "s")
    key = row_key("id", "text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(key["a"].alias("a"), key["b"].alias("b"), "text")
    single = rows.withColumn("i", F.row_number().over(Window.partitionBy("a", "b").orderBy("a"))).where("i = 1").drop("i")  # repeated rows are one
    dealt = single.join(asked, ["a", "b"]).select("y", F.col("s").alias("x"), "text", "part", (F.col("s") == F.col("y")).alias("leads")).repartition("y", "part")
    return dealt.sortWithinPartitions("y", "part", F.desc("leads"), "x").select("y", "x", "text").mapInArrow(run, _COMPARED)


def linked(same: Column, nx: Column, ny: Column) -> Column:
    return 100 * same >= PERCENT * (nx + ny - same)


def _counts(of: list[np.ndarray], found: np.ndarray, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from digests to how many of them each of the arrays holds."""
    keys, owner = np.concatenate([*of, found[:0]]), np.repeat(np.arange(size), [len(a) for a in of])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]

    def count(asked: np.ndarray) -> np.ndarray:
        at, end = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        n = end - at
        return np.bincount(owner[np.repeat(at - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())], minlength=size)

    return count


def linked_by_differences(stars: DataFrame) -> DataFrame:
    """(x, y): links between sets of one leader that are in different components, one for each x and component, from stars (y, x, ny, nx,
    lacks, besides, comp, led): led, if x is in its leader's component. Blocks of 512 sets that aren't meet blocks of all."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        asks = np.array(rows["asks"], bool)
        arrays = lambda name: [np.array(v, np.int64) for v in rows[name]]
        lacks, besides, size, comp, x = arrays("lacks"), arrays("besides"), np.array(rows["nx"]), rows["comp"], rows["x"]
        of = np.flatnonzero(~asks)
        none = np.zeros(0, np.int64)
        in_lacks, in_besides = (_counts([a[i] for i in of], none, len(of)) for a in (lacks, besides))
        short = np.array([len(lacks[i]) for i in of], np.int64)
        found = []
        for i in np.flatnonzero(asks) if len(of) else ():
            same = rows["ny"][i] - len(lacks[i]) - short + in_lacks(lacks[i]) + in_besides(besides[i])
            ok = 100 * same >= PERCENT * (size[i] + size[of] - same)
            found += {comp[j]: (x[i], x[j]) for j in of[ok] if comp[j] != comp[i]}.values()
        return pa.table([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["x", "y"])

    number = lambda test: F.greatest(F.ceil(F.count_if(test) / BLOCK), F.lit(1)).cast("int")
    open_ = stars.groupBy("y").agg(number(~F.col("led")).alias("nask"), number(F.lit(True)).alias("nall"), F.count_if(~F.col("led")).alias("open")).where("open > 0")
    rows = stars.join(open_, "y")
    place = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where(~F.col("led")).withColumn("asks", F.lit(True)).withColumn("p", place("nask")).withColumn("q", every("nall"))
    asked = rows.withColumn("asks", F.lit(False)).withColumn("q", place("nall")).withColumn("p", every("nask"))
    return asking.unionByName(asked).select("y", "p", "q", "asks", "x", "ny", "nx", "lacks", "besides", "comp").groupBy("y", "p", "q").applyInArrow(run, "x binary, y binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs."""
    of_docs = settle(sketches(docs, id_col, text_col))
    sets = of_docs.groupBy("s").agg(F.min("id").alias("least"), F.min(F.struct("n", "regs", "f0", "f1", "f2", "f3", "a", "b")).alias("z")).select("s", "least", "z.*")
    sets = settle(sets)
    banded = bands(sets.where("n > 5"))  # of smaller sets only equal ones can be linked
    crowds = banded.groupBy("k").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = settle(banded.join(crowds, "k"))
    scores = members.groupBy("s").agg(F.sum("crowd").alias("score"))
    leaders = members.join(scores, "s").groupBy("k").agg(F.max(F.struct("score", "s")).alias("m")).select("k", F.col("m")["s"].alias("y"))
    pairs = members.join(leaders, "k").where("s <> y").select(F.col("s").alias("x"), "y").distinct()
    alike = estimated(pairs, sets, ALIKE).join(scores.withColumnRenamed("s", "y"), "y")
    chosen = settle(alike.groupBy("x").agg(F.max(F.struct("score", "y")).alias("m")).select("x", F.col("m")["y"].alias("y")))
    stars = settle(compared(chosen, sets, docs, id_col, text_col, True))
    edges = stars.where(linked(F.col("same"), F.col("nx"), F.col("ny"))).select("x", "y")

    def of_comp(found: DataFrame) -> DataFrame:
        return components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))

    comp = of_comp(edges)
    with_comp = lambda rows, s, name: rows.join(comp.select(F.col("node").alias(s), F.col("root").alias(name)), s, "left").withColumn(name, F.coalesce(name, s))
    told = with_comp(with_comp(stars, "x", "comp"), "y", "of_y").withColumn("led", F.col("comp") == F.col("of_y"))
    more = settle(linked_by_differences(told))
    edges = edges.unionByName(more)
    comp = of_comp(edges)
    # what is left: sets of one band, of different components and leaders
    placed = with_comp(members, "s", "comp")
    split = placed.groupBy("k").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("k")
    led = placed.join(split, "k").join(chosen.select(F.col("x").alias("s"), F.col("y").alias("lead")), "s", "left").withColumn("lead", F.coalesce("lead", "s"))
    led = led.join(sets.select("s", "n", "f0", "f1", "f2", "f3"), "s").drop("crowd")
    other = led.select("k", *[F.col(c).alias(f"{c}_") for c in led.columns if c != "k"])
    differ = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"f{i}_"))) for i in range(4)), F.lit(0))
    fewer, larger = F.least("n", "n_"), F.greatest("n", "n_")
    limit = 128 * (1 - _J + (DEVIATIONS + 1) * F.sqrt(F.lit(_J * (1 - _J)) / F.least(fewer, F.lit(_BUCKETS))))
    unseen = (F.col("comp") != F.col("comp_")) & (F.col("lead") != F.col("lead_")) & (F.col("lead") != F.col("s_")) & (F.col("lead_") != F.col("s"))
    rest = led.join(other, "k").where((F.col("s") < F.col("s_")) & unseen & (100 * fewer >= PERCENT * larger) & (differ <= limit))
    last = settle(estimated(rest.select(F.col("s").alias("x"), F.col("s_").alias("y")).distinct(), sets))
    found = compared(last, sets, docs, id_col, text_col, False).where(linked(F.col("same"), F.col("nx"), F.col("ny"))).select("x", "y")
    comp = of_comp(edges.unionByName(found))
    rooted = with_comp(sets.select("s", "least"), "s", "root")
    classes = rooted.select("s", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s", "component_id")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return of_docs.select("id", "s", "n").join(classes, "s").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
