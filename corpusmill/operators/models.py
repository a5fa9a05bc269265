"""External models: the one place where a function of whole batches joins a plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(rows: DataFrame, model: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies model() to batches. model is made once in each task; a batch that runs out of memory is halved, down to one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = model()

        def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            try:
                yield apply(batch)
            except MemoryError:
                if batch.num_rows < 2:
                    raise
                middle = batch.num_rows // 2
                yield from halved(batch.slice(0, middle))
                yield from halved(batch.slice(middle))

        for batch in batches:
            yield from halved(batch)

    return rows.mapInArrow(run, schema)
