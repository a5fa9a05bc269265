"""A stored table with keys: upserts rewrite the buckets they touch, readers see one version.

A table is a folder. `data/<job>/bucket=<b>` holds the rows whose keys fall into a bucket, as one job wrote them; `versions/<n>.json` names,
for version n, the folder of every bucket. A job writes its buckets first and then puts the next version's file in place by a rename,
which fails if another job was faster. A job that breaks before that leaves files that no version names: readers don't see
them, and `vacuum` takes them away. Buckets that a job doesn't touch keep their files.

A job may carry a token, (name, number): a version remembers the last number of each name, and a job that comes again with that number, or
a smaller one, changes nothing. Null keys are keys like others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket"
#: Bytes of rows that one task merges, about; a larger bucket is merged by several, by parts of its keys.
PART = 32 << 20
_PART = "_part"


class Conflict(RuntimeError):
    """Another job has made the version that this one was to make."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _written(spark: SparkSession, path: str, text: str) -> None:
    """Puts a file in place as a whole; Conflict if there is one."""
    jvm = spark.sparkContext._jvm
    fs, to = _fs(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    plain = spark.sparkContext._gateway.new_array(kind, 1)
    plain[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, to, plain)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(to):
            raise Conflict(path) from e
        raise


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    buckets: int
    schema: StructType
    #: folder by bucket, and the last number by name of the tokens
    folders: dict[int, str]
    done: dict[str, int]

    def text(self) -> str:
        return json.dumps({"number": self.number, "keys": self.keys, "buckets": self.buckets, "schema": json.loads(self.schema.json()), "folders": self.folders, "done": self.done})


class Store:
    """A table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, schema: str | StructType, keys: list[str], buckets: int = 64) -> Store:
        """Makes the table if it isn't there; one that is stays as it is."""
        if self.latest() is None:
            kind = self.spark.createDataFrame([], schema).schema
            try:
                _written(self.spark, self._path(0), Version(0, keys, buckets, kind, {}, {}).text())
            except Conflict:
                pass  # made meanwhile
        return self

    def _path(self, number: int) -> str:
        return f"{self.folder}/versions/{number:012d}.json"

    def latest(self) -> Version | None:
        fs, path = _fs(self.spark, f"{self.folder}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []
        return self.version(int(names[-1].split(".")[0])) if names else None

    def version(self, number: int) -> Version:
        fs, path = _fs(self.spark, self._path(number))
        stream = fs.open(path)
        try:
            x = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(x["number"], x["keys"], x["buckets"], StructType.fromJson(x["schema"]), {int(b): f for b, f in x["folders"].items()}, x["done"])

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the latest version, of an earlier one, or of some buckets."""
        v = self.latest() if number is None else self.version(number)
        if v is None:
            raise ValueError(f"no table in {self.folder}")
        paths = [f"{self.folder}/{f}" for b, f in sorted(v.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    def _bucket(self, v: Version) -> Column:
        return F.pmod(self._digest(v), F.lit(v.buckets)).cast("int")

    def _digest(self, v: Version) -> Column:
        return F.xxhash64(*[c for k in v.keys for c in (F.col(k).isNull(), F.col(k))])

    def _held(self, rows: DataFrame) -> dict[int, int]:
        """Bytes of each bucket's rows, about."""
        width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in rows.dtypes if t == "string"), F.lit(16 * len(rows.columns)))
        return {r[BUCKET]: r["n"] for r in rows.groupBy(BUCKET).agg(F.sum(width).alias("n")).collect()}  # a row a bucket

    def _switch(self, v: Version, job: str, touched: list[int], token: tuple[str, int] | None) -> Version:
        fs, _ = _fs(self.spark, self.folder)
        held = {b: f"data/{job}/{BUCKET}={b}" for b in touched if fs.exists(_fs(self.spark, f"{self.folder}/data/{job}/{BUCKET}={b}")[1])}
        folders = {b: f for b, f in v.folders.items() if b not in touched} | held
        after = Version(v.number + 1, v.keys, v.buckets, v.schema, folders, v.done | ({token[0]: token[1]} if token else {}))
        _written(self.spark, self._path(after.number), after.text())
        return after

    def _write(self, rows: DataFrame, job: str) -> None:
        rows.write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{job}")

    def upsert(self, new: DataFrame, add: list[str] | None = None, order: str | None = None, token: tuple[str, int] | None = None) -> Version:
        """Puts rows in by their keys. With `add`, these columns are summed with what is there, and other columns are the keys; else the new
        row replaces the old one, of several new ones the one that is last by `order`, or the greatest by all columns."""
        v = self.latest()
        if v is None:
            raise ValueError(f"no table in {self.folder}")
        if token and v.done.get(token[0], -1) >= token[1]:
            return v
        columns = v.schema.names
        rest = [c for c in columns if c not in v.keys]
        if add is not None and sorted(add) != sorted(rest):
            raise ValueError("what isn't added up must be a key")
        new = new.select(*[F.col(c).cast(v.schema[c].dataType).alias(c) for c in columns], *([F.col(order).alias("_order")] if order and order not in columns else []))
        job = uuid.uuid4().hex

        def combined(rows: DataFrame, by: str | None) -> DataFrame:
            keys = [BUCKET, *v.keys, *([_PART] if _PART in rows.columns else [])]
            if add is not None:
                return rows.groupBy(*keys).agg(*[F.sum(c).cast(v.schema[c].dataType).alias(c) for c in rest])
            first = F.lit(0) if by is None else F.col(by)
            best = F.max(F.struct(first.alias("_by"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])).alias("_m")
            return rows.groupBy(*keys).agg(best).select(BUCKET, *v.keys, *[F.col("_m")[f"_{i}"].alias(c) for i, c in enumerate(rest)])

        one = combined(new.withColumn(BUCKET, self._bucket(v)), "_order" if "_order" in new.columns else order)  # a row a key
        sizes = self._held(one)
        touched = list(sizes)
        if not touched:
            return self._switch(v, job, [], token)
        old = self.read(v.number, touched).withColumn(BUCKET, self._bucket(v))
        both = one.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
        there = self._held(old)
        parts = max(-(-(n + there.get(b, 0)) // PART) for b, n in sizes.items())
        if parts > 1:  # other bits of the digest than the bucket's
            both = both.withColumn(_PART, F.pmod(F.hash(self._digest(v)), F.lit(parts)))
            both = both.repartition(max(parts * len(sizes), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), BUCKET, _PART)
        else:
            both = both.repartition(BUCKET)
        merged = combined(both, "_new")  # the buckets' exchange serves the sums too
        self._write(merged.select(*columns, BUCKET), job)
        return self._switch(v, job, touched, token)

    def update(self, where: Column, token: tuple[str, int] | None = None, **values: Column) -> Version:
        """Sets columns of the rows that a condition holds for; only buckets with such rows are rewritten. Keys can't be set."""
        v = self.latest()
        if v is None or set(values) & set(v.keys):
            raise ValueError("there is no table, or a key would be set")
        if token and v.done.get(token[0], -1) >= token[1]:
            return v
        hit = F.coalesce(where, F.lit(False))
        rows = self.read(v.number).withColumn(BUCKET, self._bucket(v))
        touched = [r[BUCKET] for r in rows.where(hit).select(BUCKET).distinct().collect()]
        job = uuid.uuid4().hex
        if touched:
            old = self.read(v.number, touched).withColumn(BUCKET, self._bucket(v))
            new = old.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(v.schema[c].dataType).alias(c) if c in values else F.col(c) for c in v.schema.names], BUCKET)
            self._write(new.repartition(BUCKET), job)
        return self._switch(v, job, touched, token)

    def truncate(self) -> Version:
        """An empty version; earlier ones stay until vacuum."""
        v = self.latest()
        if v is None:
            raise ValueError(f"no table in {self.folder}")
        return self._switch(v, "", list(v.folders), None)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last `keep`, and all data that these don't name; the number of folders deleted. No job may be writing."""
        v = self.latest()
        if v is None:
            return 0
        first = max(0, v.number - keep + 1)
        fs, versions = _fs(self.spark, f"{self.folder}/versions")
        kept: set[str] = set()
        for s in fs.listStatus(versions):
            name = s.getPath().getName()
            if name.endswith(".json") and int(name.split(".")[0]) >= first:
                kept |= set(self.version(int(name.split(".")[0])).folders.values())
            else:
                fs.delete(s.getPath(), False)
        data, n = _fs(self.spark, f"{self.folder}/data")[1], 0
        for job in fs.listStatus(data) if fs.exists(data) else []:
            for b in fs.listStatus(job.getPath()):
                if b.isDirectory() and f"data/{job.getPath().getName()}/{b.getPath().getName()}" not in kept:
                    fs.delete(b.getPath(), True)
                    n += 1
            if not any(s.isDirectory() for s in fs.listStatus(job.getPath())):
                fs.delete(job.getPath(), True)
        return n


def try_upsert(store: Store, new: DataFrame, **how) -> bool:
    """Whether the rows are in; an error of Spark or a faster job leaves the table as it was."""
    try:
        store.upsert(new, **how)
    except (PySparkException, Conflict):
        return False
    return True
