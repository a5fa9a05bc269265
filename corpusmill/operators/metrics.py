"""Training metrics: weighted means, rolling means, smoothing, overtraining and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """0 without weight."""
    total = F.sum(weight)
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.sum(value * weight) / total)


def masked_mean(values: Column, mask: Column) -> Column:
    total = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))


def hit_at_1(scores: Column, target: Column) -> Column:
    """Whether the first of the highest scores is at the target's place, from 0; null without scores."""
    return F.array_position(scores, F.array_max(scores)) - 1 == target


#: Steps that one task takes in order.
BLOCK = 100_000


def _block(step: str, block: int) -> Column:
    return F.floor(F.col(step) / block)


def numbered_steps(frame: DataFrame, tag: str, key: str, name: str = "step", width: int = 1 << 16) -> DataFrame:
    """frame with the number of each row within its tag, from 1, by a key of whole numbers that don't repeat within a tag. Counts of each
    `width` keys come first, so rows are dealt out once, and no task holds more rows of a tag than a block has keys."""
    rows = frame.withColumn("_block", F.floor(F.col(key) / width))
    earlier = Window.partitionBy(tag).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(tag, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(tag, "_block").orderBy(key))
    return rows.withColumn("_i", within).join(counts, [tag, "_block"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_block", "_i", "_before")


def rolling_mean(frame: DataFrame, tag: str, step: str, value: str, window: int = 50, block: int = BLOCK) -> DataFrame:
    """(tag, step, mean) of the last `window` values, every `window` steps. Steps are whole numbers without gaps; a block of them also
    takes the end of the one before."""
    own = _block(step, block)
    each = F.explode(F.when(F.pmod(F.col(step), F.lit(block)) > block - window, F.array(own, own + 1)).otherwise(F.array(own)))
    over = Window.partitionBy(tag, "_block").orderBy(step).rowsBetween(1 - window, 0)
    rows = frame.select(tag, step, value, each.alias("_block")).withColumn("mean", F.avg(value).over(over))
    return rows.where((F.col("_block") == own) & (F.col(step) % window == 0)).select(tag, step, "mean")


def running(frame: DataFrame, tag: str, step: str, value: Column, fold, name: str, own: bool, block: int = BLOCK) -> DataFrame:
    """frame with fold (min or max) of the value over the steps of the tag so far, this one's `own` value with them or not. Blocks of
    steps are folded by themselves, then one row for each of them, and then their rows."""
    rows = frame.withColumns({"_block": _block(step, block), "_value": value})
    earlier = Window.partitionBy(tag).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(tag, "_block").agg(fold("_value").alias("_all")).withColumn("_before", fold("_all").over(earlier)).drop("_all")
    within = Window.partitionBy(tag, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    pick = F.least if fold is F.min else F.greatest
    joined = rows.join(blocks, [tag, "_block"]).withColumn(name, fold("_value").over(within))
    return joined.withColumn(name, pick(F.col(name), F.col("_before"))).drop("_block", "_value", "_before")


def smooth(values: Column, keep: float = 0.987) -> Column:
    """The smoothed history of an ordered array: the first value, then keep * last + (1 - keep) * value."""
    return F.aggregate(
        values,
        F.expr("cast(array() as array<double>)"),
        lambda out, x: F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(F.try_element_at(out, F.lit(-1)) * keep + x * (1 - keep)))),
    )


def smoothed_series(frame: DataFrame, tag: str, step: str, value: str, keep: float = 0.987, block: int = 10_000) -> DataFrame:
    """(tag, step, smoothed), steps being whole numbers. Blocks of steps are smoothed from 0 by themselves; the ends of blocks are
    then chained, one row for each, and a block's rows take what comes from before, which fades by `keep` a row."""
    import pandas as pd

    def local(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        smoothed, last = [], 0.0
        for x in rows["value"]:
            last = keep * last + (1 - keep) * x
            smoothed.append(last)
        return rows.assign(local=smoothed, i=range(1, len(rows) + 1))

    def chained(key: tuple, ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("block")
        starts, last = [], float(ends["first"].iloc[0])  # a series begins at its first value
        for end, n in zip(ends["end"], ends["n"]):
            starts.append(last)
            last = end + last * keep**n
        return ends.assign(start=starts)[["tag", "block", "start"]]

    kind = frame.schema[tag].dataType.simpleString()
    rows = frame.select(F.col(tag).alias("tag"), F.floor(F.col(step) / block).alias("block"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    folded = rows.groupBy("tag", "block").applyInPandas(local, f"tag {kind}, block long, step long, value double, local double, i long")
    ends = folded.groupBy("tag", "block").agg(F.min_by("value", "i").alias("first"), F.max_by("local", "i").alias("end"), F.max("i").alias("n"))
    starts = ends.groupBy("tag").applyInPandas(chained, f"tag {kind}, block long, start double")
    smoothed = F.col("local") + F.col("start") * F.pow(F.lit(keep), F.col("i"))
    return folded.join(starts, ["tag", "block"]).select(F.col("tag").alias(tag), F.col("step").cast(frame.schema[step].dataType).alias(step), smoothed.alias("smoothed"))


def overtrained(values: Column, last: int, change: float = 0.004) -> Column:
    """Whether the last values stand still or rise before they move by `change`; false with fewer than last + 1."""
    n = F.size(values)
    recent = F.slice(values, F.greatest(n - last + 1, F.lit(1)), F.lit(last))
    later = F.slice(recent, 2, last)
    pairs = F.zip_with(F.slice(recent, 1, last - 1), later, lambda a, b: F.when(b > a, True).when(F.abs(b - a) >= change, False))
    return F.when(n < last + 1, False).otherwise(F.coalesce(F.try_element_at(F.filter(pairs, lambda x: x.isNotNull()), F.lit(1)), F.lit(True)))


def records(frame: DataFrame, tag: str, step: str, value: str, block: int = BLOCK) -> DataFrame:
    """Rows that go below everything before."""
    before = running(frame, tag, step, F.col(value), F.min, "_least", False, block)
    return before.where(F.col("_least").isNull() | (F.col(value) < F.col("_least"))).drop("_least")


def runs(frame: DataFrame, tag: str, step: str, hit: Column, block: int = BLOCK) -> DataFrame:
    """frame with `streak`: how many hits in a row end at this step. Steps are whole numbers without gaps, from 1."""
    last = running(frame, tag, step, F.when(hit, F.lit(None)).otherwise(F.col(step)), F.max, "_miss", True, block)
    return last.withColumn("streak", F.col(step) - F.coalesce("_miss", F.lit(0))).drop("_miss")


def overtrained_steps(frame: DataFrame, tag: str, step: str, value: str, last: int, change: float = 0.004, block: int = BLOCK) -> DataFrame:
    """(tag, step, hit): what overtrained() says of the values up to each step. Steps are whole numbers without gaps, from 1; a block of
    them also takes the end of the one before."""
    own = _block(step, block)
    each = F.explode(F.when(F.pmod(F.col(step), F.lit(block)) >= block - last, F.array(own, own + 1)).otherwise(F.array(own)))
    order = Window.partitionBy(tag, "_block").orderBy(step)
    rows = frame.select(tag, step, value, each.alias("_block")).withColumn("_by", F.col(value) - F.lag(value).over(order))
    kind = F.when(F.col("_by") > 0, True).when(F.abs("_by") >= change, False)
    first = F.first(kind, ignorenulls=True).over(order.rowsBetween(2 - last, 0)) if last > 1 else F.lit(None).cast("boolean")
    rows = rows.withColumn("hit", F.when(F.col(step) <= last, False).otherwise(F.coalesce(first, F.lit(True))))
    return rows.where(F.col("_block") == own).select(tag, step, "hit")


def first_stop(frame: DataFrame, tag: str, step: str, generator: str, discriminator: str, patience: int, changes: tuple[float, float] = (0.01, 0.004), keep: float = 0.987, block: int = BLOCK) -> DataFrame:
    """(tag, step): where training stops, null if it goes on. Both losses are smoothed; the generator's is judged by its last `patience`
    values, the discriminator's by twice as many. Training stops at the first step at which the generator has been overtrained for
    `patience` steps in a row, or the discriminator for twice as many.

    Each counter is a count of hits in a row, so where it first stands at its limit is found by blocks of steps: a series is no one task's.
    """
    ends = []
    for value, last, change in ((generator, patience, changes[0]), (discriminator, 2 * patience, changes[1])):
        smoothed = smoothed_series(frame, tag, step, value, keep, block)
        hits = overtrained_steps(smoothed, tag, step, "smoothed", last, change, block)
        ends.append(runs(hits, tag, step, F.col("hit"), block).where(F.col("streak") == last).select(tag, step))
    found = ends[0].unionByName(ends[1]).groupBy(tag).agg(F.min(step).alias(step))
    return frame.select(tag).distinct().join(found, tag, "left")


def write_history(frame: DataFrame, tag: str, step: str, values: list[str], folder: str, block: int = BLOCK) -> None:
    """Histories of any length as lines of JSON, one for each block of steps of a series: its tag, its name, the step that it starts at,
    its values. Steps are whole numbers without gaps. A folder that is there is an error."""
    series = F.explode(F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("value")) for v in values]))
    rows = frame.select(F.col(tag).alias("tag"), F.col(step).cast("long").alias("step"), series.alias("s")).select("tag", "step", "s.*")
    held = rows.groupBy("tag", "series", F.floor(F.col("step") / block).alias("block")).agg(F.min("step").alias("start"), F.array_sort(F.collect_list(F.struct("step", "value"))).alias("v"))  # a block
    held.select("tag", "series", "start", F.transform("v", lambda x: x["value"]).alias("values")).write.option("ignoreNullFields", "false").json(folder)


def read_history(spark: SparkSession, folder: str, kind: str = "string") -> DataFrame:
    """(tag, series, step, value) of what write_history put down, each block by itself."""
    lines = spark.read.schema(f"tag {kind}, series string, start long, values array<double>").json(folder)
    return lines.select("tag", "series", "start", F.posexplode("values").alias("at", "value")).select("tag", "series", (F.col("start") + F.col("at")).alias("step"), "value")


def dump_history(frame: DataFrame, tag: str, step: str, value: str) -> DataFrame:
    """(tag, history): the values of each tag in order, as JSON."""
    listed = F.array_sort(F.collect_list(F.struct(step, value)))
    return frame.groupBy(tag).agg(listed.alias("_h")).select(tag, F.to_json(F.transform("_h", lambda x: x[value])).alias("history"))


def load_history(dumped: DataFrame, tag: str, step: str, value: str) -> DataFrame:
    """(tag, step, value) of what dump_history made; steps from 1. No history is an empty one."""
    values = F.coalesce(F.from_json("history", "array<double>"), F.expr("cast(array() as array<double>)"))
    return dumped.select(tag, F.posexplode(values).alias("_at", value)).select(tag, (F.col("_at") + 1).cast("long").alias(step), value)


def elapsed(frame: DataFrame, tag: str, order: str, at: Column, span: int = 86_400) -> DataFrame:
    """frame with seconds since the record before of the same tag; null for the first. `order` goes with the time `at`. Times are taken by
    blocks of `span` seconds; the last record of each is carried to the next one that there is."""
    time = at.cast("timestamp").cast("double")
    rows = frame.withColumns({"_at": time, "_block": F.floor(time / span)})
    blocks = rows.groupBy(tag, "_block").agg(F.max_by("_at", order).alias("_end"))
    blocks = blocks.withColumn("_carried", F.lag("_end").over(Window.partitionBy(tag).orderBy("_block"))).drop("_end")
    before = F.lag("_at").over(Window.partitionBy(tag, "_block").orderBy(order))
    joined = rows.withColumn("_before", before).join(blocks.select(F.col(tag).alias("_t"), F.col("_block").alias("_b"), "_carried"), F.col(tag).eqNullSafe(F.col("_t")) & F.col("_block").eqNullSafe(F.col("_b")))
    return joined.withColumn("seconds", F.col("_at") - F.coalesce("_before", "_carried")).drop("_at", "_block", "_before", "_carried", "_t", "_b")
