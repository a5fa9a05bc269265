"""A corpus in stages that can be stopped and go on: chunks, normalised chunks, words, syllables.

Each stage is a stream of its own over what the stage before has put down, with its own offsets, and ends when there is nothing left
(`availableNow`). Batch n of a stage is the folder `n` of its results, written once: a batch that runs again, after a failure, finds its
folder complete and leaves it, so that the next stage never sees a row twice. Totals go to stored tables, which remember the last
batch that they took.

A file named `stop` in the base folder ends the run before the next batch of any stage; `run` takes up where it ended, once it is
gone. Every stage maps counts to counts, each row with its own weight, so totals don't depend on how files fell into batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as c
from ..sources.store import Store, _fs


class Stopped(RuntimeError):
    """The run was asked to end before this batch."""


@dataclass(frozen=True)
class Stage:
    """`make` turns a batch of the stage before into rows of `schema`; where there are `keys`, the rest is summed in a stored table."""

    name: str
    schema: str
    make: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ()


def corpus_stages(size: int = 10) -> list[Stage]:
    """From documents (lang, text, ...) to chunks, normalised chunks, words and syllables, each with its count."""
    return [
        Stage("chunks", "lang string, text string, occurrence_count long", lambda d: c.dedup_count(c.chunk(d, "text", size, ("lang",)), "lang", "text")),
        Stage("normalized_chunks", "lang string, text string, occurrence_count long", lambda d: c.normalized_chunks(d, count="occurrence_count"), ("lang", "text")),
        Stage("words", "lang string, word string, frequency long", c.word_frequency, ("lang", "word")),
        Stage("syllables", "lang string, syllable string, frequency long", c.syllable_frequency, ("lang", "syllable")),
    ]


class Stages:
    """The run of stages over a folder of files, in a base folder that all executors share."""

    def __init__(self, spark: SparkSession, source: str, schema, base: str, stages: list[Stage], files_per_batch: int = 64, buckets: int = 64):
        self.spark, self.source, self.schema, self.base, self.stages, self.files, self.buckets = spark, source, schema, base.rstrip("/"), stages, files_per_batch, buckets

    def _there(self, path: str) -> bool:
        fs, p = _fs(self.spark, path)
        return fs.exists(p)

    def stop(self) -> None:
        """Asks the run to end before its next batch."""
        fs, p = _fs(self.spark, f"{self.base}/stop")
        fs.create(p, True).close()

    def resume(self) -> None:
        fs, p = _fs(self.spark, f"{self.base}/stop")
        fs.delete(p, False)

    def stopped(self) -> bool:
        return self._there(f"{self.base}/stop")

    def store(self, name: str) -> Store:
        """The totals of a stage with keys."""
        return Store(self.spark, f"{self.base}/tables/{name}")

    def batches(self, name: str) -> int:
        """How many batches of a stage are complete."""
        fs, p = _fs(self.spark, f"{self.base}/results/{name}")
        return sum(self._there(f"{s.getPath()}/_SUCCESS") for s in fs.listStatus(p)) if fs.exists(p) else 0

    def _one(self, stage: Stage, source: str, schema, after: Callable[[str, int], None] | None) -> None:
        reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files).option("recursiveFileLookup", True)
        total = self.store(stage.name).create(stage.schema, list(stage.keys), self.buckets) if stage.keys else None
        names = [x.split()[0] for x in stage.schema.split(", ")]

        def take(batch: DataFrame, number: int) -> None:
            if self.stopped():
                raise Stopped(stage.name)
            place = f"{self.base}/results/{stage.name}/{number:08d}"
            if not self._there(f"{place}/_SUCCESS"):
                stage.make(batch).select(*names).write.mode("overwrite").parquet(place)
            if total is not None:
                total.upsert(self.spark.read.schema(stage.schema).parquet(place), add=[n for n in names if n not in stage.keys], token=(stage.name, number))
            if after:
                after(stage.name, number)

        query = reader.parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", f"{self.base}/offsets/{stage.name}").trigger(availableNow=True).start()
        query.awaitTermination()

    def run(self, after: Callable[[str, int], None] | None = None) -> bool:
        """Takes all files that no batch has taken, stage by stage; false if it was stopped before the end. `after` is called at the
        end of each batch."""
        source, schema = self.source, self.schema
        for stage in self.stages:
            if self.stopped():
                return False
            try:
                self._one(stage, source, schema, after)
            except StreamingQueryException:
                if self.stopped():
                    return False
                raise
            source, schema = f"{self.base}/results/{stage.name}", stage.schema
        return True
