"""Queries of the metric operators, with events as the history of training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..session import delete, own_folder, settled
from .registry import query, table

_STEPS = "steps as (select event_type as tag, row_number() over (partition by event_type order by event_id) as step, event_id, value from events)"


def _steps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), "event_id", "value")
    return m.numbered_steps(events, "tag", "event_id").select("tag", "step", "event_id", "value")


@query(f"with {_STEPS} select tag, step, round(mean, 6) as mean from (select tag, step, avg(value) over (partition by tag order by step rows between 49 preceding and current row) as mean from steps) where step % 50 = 0")
def rolling_mean_50(spark, sf_dir):
    return m.rolling_mean(_steps(spark, sf_dir), "tag", "step", "value").withColumn("mean", F.round("mean", 6))


@query(
    f"""with {_STEPS} select tag, step, round(pow(0.987, step - 1) * first_value(value) over w + 0.013 * pow(0.987, step) * coalesce(sum(case when step > 1 then value * pow(0.987, -step) end) over w, 0), 5) as smoothed from steps window w as (partition by tag order by step)"""
)
def ema_loss(spark, sf_dir):
    """Every step of every tag, by blocks that are chained; in SQL the recursion is written out as a sum."""
    return m.smoothed_series(_steps(spark, sf_dir), "tag", "step", "value").withColumn("smoothed", F.round("smoothed", 5))


@query("select l.quality, l.toxic, round(sum(d.n_chars * 0.5 * (l.doc_id % 5)) / sum(l.doc_id % 5), 6) as mean from labels l join documents d using (doc_id) group by all")
def weighted_eval(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.round(m.weighted_mean(F.col("n_chars") * F.expr("0.5D"), F.col("doc_id") % 5), 6).alias("mean"))


@query("select toxic, avg(cast(quality = 1 - toxic as integer)) as accuracy, count(*) as n from labels group by toxic")
def top1_accuracy(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("toxic").agg(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


@query("with s as (select label, embedding[1:10] as s from embeddings) select label, avg(cast(list_position(s, list_max(s)) - 1 = label as integer)) as accuracy, count(*) as n from s group by label")
def argmax_accuracy(spark, sf_dir):
    """The first ten components as scores of the ten labels."""
    hit = m.hit_at_1(F.slice("embedding", 1, 10), F.col("label"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(hit.cast("int")).alias("accuracy"), F.count("*").alias("n"))


@query("select vec_id, round(list_sum(list_transform(embedding[1:16], lambda x, i: cast(x as double) * (i % 3))) / greatest(list_sum(list_transform(range(1, 17), lambda i: i % 3)), 1), 5) as mean from embeddings")
def masked_mean(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double"))
    mask = F.transform(v, lambda x, i: ((i + 1) % 3).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(m.masked_mean(v, mask), 5).alias("mean"))


@query(f"with {_STEPS} select tag, step, value from (select *, min(value) over (partition by tag order by step rows between unbounded preceding and 1 preceding) as least from steps) where least is null or value < least")
def min_so_far(spark, sf_dir):
    return m.records(_steps(spark, sf_dir), "tag", "step", "value").select("tag", "step", "value")


@query(
    f"""with {_STEPS}, marked as (select *, value < 20 as hit, sum(case when value < 20 then 0 else 1 end) over (partition by tag order by step) as island from steps)
select tag, step, cast(coalesce(sum(cast(hit as integer)) over (partition by tag, island order by step), 0) as bigint) as streak from marked"""
)
def hit_streaks(spark, sf_dir):
    return m.runs(_steps(spark, sf_dir), "tag", "step", F.col("value") < 20).select("tag", "step", "streak")


@query(
    f"""with {_STEPS}, b as (select tag, step // 10 as block, list(value order by step) as v from steps group by all), p as (select tag, block, v, list_filter(list_transform(range(len(v) - 3, len(v)), lambda i: case when v[i + 1] > v[i] then 1 when abs(v[i + 1] - v[i]) >= 30 then 0 else null end), lambda x: x is not null) as d from b)
select tag, block, case when len(v) < 5 then false else coalesce(d[1] = 1, true) end as flag from p"""
)
def overtrain_flag(spark, sf_dir):
    b = _steps(spark, sf_dir).groupBy("tag", F.floor(F.col("step") / 10).alias("block")).agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("s"))
    return b.select("tag", "block", m.overtrained(F.transform("s", lambda x: x["value"]), 4, 30.0).alias("flag"))


@query(f"with {_STEPS} select tag, step, round((0.2 * value + 0.8 * (value / 2)) / 4, 6) as loss, step % 50 = 0 as validate, cast(50 - step % 50 as integer) as steps_left from steps")
def composite_loss(spark, sf_dir):
    v, n = F.col("value"), F.col("step")
    loss = (F.expr("0.2D") * v + F.expr("0.8D") * (v / 2)) / 4
    return _steps(spark, sf_dir).select("tag", "step", F.round(loss, 6).alias("loss"), (n % 50 == 0).alias("validate"), (50 - n % 50).cast("int").alias("steps_left"))


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def json_fallback(spark, sf_dir):
    """A JSON field, or what a pattern finds where the JSON can't be read."""
    parsed = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(parsed, F.expr("try_cast(nullif(regexp_extract(props, '\"?k\"?\\\\s*:\\\\s*([0-9]+)', 1), '') as int)")).alias("k"))


@query("select event_type as tag, count(*) as points, round(min(value), 6) as least, cast(arg_min(event_id, struct_pack(v := value, e := event_id)) as bigint) as at from events group by event_type")
def history_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("points"), F.round(F.min("value"), 6).alias("least"), F.min_by("event_id", F.struct("value", "event_id")).alias("at"))


@query(f"with {_STEPS} select tag, step, value from steps")
def history_round_trip(spark, sf_dir):
    """The history of each tag dumped as JSON and loaded again."""
    return m.load_history(m.dump_history(_steps(spark, sf_dir), "tag", "step", "value"), "tag", "step", "value")


@query(f"with {_STEPS} select tag, 'loss' as series, step, value from steps union all select tag, 'half', step, value / 2 from steps")
def history_blocks(spark, sf_dir):
    """The history of each tag, and another beside it, written by blocks and read back."""
    folder = own_folder(spark, "history")
    rows = _steps(spark, sf_dir).select("tag", "step", F.col("value").alias("loss"), (F.col("value") / 2).alias("half"))
    try:
        m.write_history(rows, "tag", "step", ["loss", "half"], folder, 1000)
        return settled(m.read_history(spark, folder))
    finally:
        delete(spark, folder)


@query()
def stop_step(spark, sf_dir):
    """Where the stop rule would end the training of each tag; tests hold it against the plain loop."""
    rows = _steps(spark, sf_dir).select("tag", "step", F.col("value").alias("g"), (100 - F.col("value")).alias("d"))
    return m.first_stop(rows, "tag", "step", "g", "d", 4)


@query("select event_id, round(epoch(ts) - lag(epoch(ts)) over (partition by event_type order by ts, event_id), 4) as seconds from events")
def elapsed_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tag"), F.struct("ts", "event_id").alias("at"))
    return m.elapsed(e, "tag", "at", F.col("at.ts")).select("event_id", F.round("seconds", 4).alias("seconds"))
