"""Queries of vector and signal functions, over embeddings as vectors and short waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vc
from ..operators import index as ix
from ..operators.corpus import one_per_group
from ..session import delete, own_folder, settled
from .registry import query, table

_E = "cast(embedding as double[])"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _list(xs) -> str:
    return "[" + ", ".join(map(str, xs)) + "]"


@query(f"with e as (select vec_id, label, {_E} as x from embeddings), q as (select x as y from e where vec_id = 0), s as (select label, vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) as sim from e, q where vec_id <> 0) select label, vec_id, sim from (select *, row_number() over (partition by label order by sim desc, vec_id) as r from s) where r = 1")
def cosine_argmax(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = F.broadcast(v.where("vec_id = 0").agg(F.min("x").alias("y")))  # one row, however often the id is there
    sim = F.round(vc.cosine(F.col("x"), F.col("y")), 6)
    best = F.max_by(F.struct("vec_id", "sim"), F.struct("sim", (-F.col("vec_id")).alias("v")))
    return v.where("vec_id <> 0").crossJoin(q).select("label", "vec_id", sim.alias("sim")).groupBy("label").agg(best.alias("b")).select("label", "b.vec_id", "b.sim")


@query(f"select vec_id, round(list_sum(list_transform({_E}[1:8], lambda v, i: abs(v) * {_list(vc.BIAS)}[i])), 6) as total from embeddings")
def emotion_bias(spark, sf_dir):
    x = F.transform(F.slice("x", 1, 8), F.abs)
    scaled = F.zip_with(x, F.array(*map(F.lit, vc.BIAS)), lambda a, b: a * b)
    return _vectors(spark, sf_dir).select("vec_id", F.round(vc.total(scaled), 6).alias("total"))


_BIASED = f"list_transform(list_transform({_E}[1:8], lambda v: abs(v) * 5), lambda v, i: v * {_list(vc.BIAS)}[i])"


@query(f"with b as (select vec_id, {_BIASED} as b from embeddings) select vec_id, round(list_transform(b, lambda v: case when list_sum(b) > 1 then v / list_sum(b) else v end)[1], 6) as first, round(list_sum(list_transform(b, lambda v: case when list_sum(b) > 1 then v / list_sum(b) else v end)), 6) as total from b")
def emotion_norm(spark, sf_dir):
    n = vc.emotion_vector(F.transform(F.slice("x", 1, 8), lambda v: F.abs(v) * 5))
    v = _vectors(spark, sf_dir).withColumn("n", n)
    return v.select("vec_id", F.round(F.element_at("n", 1), 6).alias("first"), F.round(vc.total(F.col("n")), 6).alias("total"))


@query(f"with e as (select label, vec_id, {_E} as x from embeddings) select label, cast(d as integer) as dim, round(sum(v * (vec_id % 3)), 5) as v from (select label, vec_id, unnest(x) as v, unnest(range(0, len(x))) as d from e) group by label, d")
def vector_sum(spark, sf_dir):
    return _vectors(spark, sf_dir).select("label", "vec_id", F.posexplode("x").alias("dim", "v")).groupBy("label", "dim").agg(F.round(F.sum(F.col("v") * (F.col("vec_id") % 3)), 5).alias("v"))


@query(f"select vec_id, round(list_sum(list_transform({_E}[1:8], lambda v, i: v + (1 - 0.25) * {_E}[8 + i])), 6) as total from embeddings")
def vector_blend(spark, sf_dir):
    b = vc.blend(F.slice("x", 1, 8), F.array(F.lit(0.125), F.lit(0.125)), F.slice("x", 9, 8))
    return _vectors(spark, sf_dir).select("vec_id", F.round(vc.total(b), 6).alias("total"))


@query(f"select vec_id, round(list_sum(list_transform({_E}[1:8], lambda v: trunc(v * 0.6 * 10000) / 10000)), 6) as total from embeddings")
def emotion_strength(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(vc.total(vc.strength(F.slice("x", 1, 8), 0.6)), 6).alias("total"))


@query(f"with c as (select vec_id, list_transform({_E}[1:8], lambda v: greatest(0.0, least(v * 10, 1.2))) as c from embeddings) select vec_id, round(case when list_max(c) > 0 then list_sum(c) else 1.0 end, 6) as total from c")
def emotion_clamp(spark, sf_dir):
    c = vc.clamped_scores(F.transform(F.slice("x", 1, 8), lambda v: v * 10))
    return _vectors(spark, sf_dir).select("vec_id", F.round(vc.total(c), 6).alias("total"))


_WAVE = f"list_transform({_E}, lambda v, i: case when i > 40 then v * 0.01 else v end)"


@query(f"with w as (select vec_id, {_WAVE} as w from embeddings), t as (select vec_id, w, list_max(list_transform(w, lambda v: abs(v))) as m from w) select vec_id, cast(case when m > 0 then least(list_max(list_transform(w, lambda v, i: case when abs(v) > m * pow(10, -30 / 20.0) then i else 0 end)) + 4, len(w)) else len(w) end as integer) as n from t")
def trim_silence(spark, sf_dir):
    w = F.transform("x", lambda v, i: F.when(i >= 40, v * F.expr("0.01D")).otherwise(v))
    return _vectors(spark, sf_dir).select("vec_id", F.size(vc.trimmed(w, 40)).alias("n"))


@query(f"select vec_id, round(list_max(list_transform({_E}, lambda v: v / list_max(list_transform({_E}, lambda z: abs(z))) * 0.675 + v * 0.25)), 6) as peak, round(list_max(list_transform({_E}, lambda v: greatest(-32767.0, least(v * 100000, 32767.0)))), 4) as loudest from embeddings")
def peak_and_pcm(spark, sf_dir):
    scaled = F.transform("x", lambda v: F.greatest(F.lit(-32767.0), F.least(v * 100000, F.lit(32767.0))))
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.array_max(vc.peak_normalized(F.col("x"))), 6).alias("peak"), F.round(F.array_max(scaled), 4).alias("loudest"))


_MEL = "1127.0 * ln(1 + hz / 700)"


@query(f"with h as (select event_id, value * 10 as hz from events), s as (select event_id, {_MEL} as m from h) select event_id, cast(round_even(greatest(1.0, least(case when m > 0 then (m - 1127 * ln(1 + 50 / 700.0)) * 254 / (1127 * ln(1 + 1100 / 700.0) - 1127 * ln(1 + 50 / 700.0)) + 1 else m end, 255.0)), 0) as integer) as bin from s")
def coarse_f0(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", vc.coarse_pitch(F.col("value") * 10).alias("bin"))


@query("select label, count(*) as n, cast(greatest(1, least(floor(16 * sqrt(count(*))), count(*) // 39)) as integer) as lists from embeddings group by label")
def ivf_size(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", "n", vc.ivf_lists(F.col("n")).alias("lists"))


@query(f"select vec_id, cast(coalesce(list_position(list_transform({_E}, lambda v: v > 0.2), true) - 1, len(embedding)) as integer) as code_len, list_bool_or(list_transform({_E}, lambda v: isnan(v))) as has_nan from embeddings")
def code_length(spark, sf_dir):
    at = F.array_position(F.transform("x", lambda v: v > 0.2), True)
    return _vectors(spark, sf_dir).select("vec_id", F.when(at > 0, at - 1).otherwise(F.size("x")).cast("int").alias("code_len"), F.exists("x", F.isnan).alias("has_nan"))


def _impulse(n: int) -> list[float]:
    """The first n values that the filter answers one with."""
    b, a = vc.high_pass()
    out: list[float] = []
    for i in range(n):
        out.append(float((b[i] if i < len(b) else 0.0) - sum(a[j] * out[i - j] for j in range(1, min(i, len(a) - 1) + 1))))
    return out


@query(f"with h as (select list_reverse({_list(map(repr, _impulse(64)))}) as h), y as (select vec_id, list_transform(range(1, len(embedding) + 1), lambda n: list_dot_product({_E}[1:n], h[65 - n:64])) as y from embeddings, h) select vec_id, round(list_dot_product(y, y), 9) as energy from y")
def high_pass(spark, sf_dir):
    b, a = vc.high_pass()
    y = vc.filtered(F.col("x"), b, a)
    return _vectors(spark, sf_dir).select("vec_id", F.round(vc.total(F.transform(y, lambda v: v * v)), 9).alias("energy"))


@query("select vec_id, len(embedding) - 1 as vocab, len(embedding) - 3 as mel from embeddings")
def layer_shapes(spark, sf_dir):
    n = F.size("x").cast("long")
    return _vectors(spark, sf_dir).select("vec_id", (n - 1).alias("vocab"), (n - 3).alias("mel"))


@query("select label, arg_min(vec_id, md5('7:' || vec_id)) as vec_id from embeddings group by label")
def random_per_group(spark, sf_dir):
    return one_per_group(_vectors(spark, sf_dir).select("label", "vec_id"), "label", "vec_id", 7)


_SAYS = "[" + ", ".join(f"'{w}'" for w in vc.MELANCHOLIC) + "]"
_NAMED = f"len(list_filter({_SAYS}, lambda w: contains(lower(text || ' ' || case when doc_id % 2 = 0 then upper({_SAYS}[doc_id // 2 % 14 + 1]) else 'calm' end), w))) > 0"


@query(f"with n as (select doc_id, {_NAMED.replace('upper(', '(')} as named from documents) select doc_id, case when named then 5 else 2 end as sad, case when named then 2 else 5 end as melancholic from n")
def melancholic_swap(spark, sf_dir):
    """Texts that name melancholy have sad and melancholic change places."""
    word = F.element_at(F.array(*map(F.lit, vc.MELANCHOLIC)), (F.floor(F.col("doc_id") / 2) % 14 + 1).cast("int"))
    text = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 2 == 0, word).otherwise("calm"))
    s = vc.melancholic(F.array(*map(F.lit, range(8))), text)
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(s, 3).alias("sad"), F.element_at(s, 6).alias("melancholic"))


@query(f"with m as (select vec_id, list_transform(list_zip({_E}[1:32], {_E}[33:64]), lambda z: (z[1] + z[2]) / 2) as m from embeddings) select vec_id, cast(len(m[1:20]) as integer) as n, round(list_sum(m[1:20]), 6) as total from m")
def mono_truncated(spark, sf_dir):
    """Two channels as their mean, cut to half a second of 40 samples a second."""
    m = vc.truncated(vc.mono(F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))), 40, 0.5)
    v = _vectors(spark, sf_dir).select("vec_id", m.alias("m"))
    return v.select("vec_id", F.size("m").alias("n"), F.round(vc.total(F.col("m")), 6).alias("total"))


@query(f"select vec_id, len(embedding) - vec_id % 8 >= 60 and list_max(list_transform({_E}[1:len(embedding) - vec_id % 8], lambda v: abs(v * 10))) <= 2.5 as usable from embeddings")
def usable_waves(spark, sf_dir):
    w = F.transform(F.slice(F.col("x"), F.lit(1), (F.size("x") - F.col("vec_id") % 8).cast("int")), lambda v: v * 10)
    return _vectors(spark, sf_dir).select("vec_id", vc.usable(w, 40).alias("usable"))


@query("select doc_id, cast(floor(22050 * (n_chars % 500 + 1) / 1000) as integer) as samples, cast(0 as double) as loudest, cast(doc_id % 7 + 1 as integer) as frames, 256 as size from documents")
def silence_templates(spark, sf_dir):
    """As many milliseconds of nothing as a document's length asks for, and frames of it."""
    made = table(spark, sf_dir, "documents").select("doc_id", vc.silence(22050, F.col("n_chars") % 500 + 1).alias("s"), vc.silent_frames((F.col("doc_id") % 7 + 1).cast("int"), 256).alias("f"))
    return made.select("doc_id", F.size("s").alias("samples"), F.array_max("s").alias("loudest"), F.size("f").alias("frames"), F.size(F.element_at("f", 1)).alias("size"))


_NEAR = f"c as (select row_number() over (order by md5('0:' || vec_id), vec_id) - 1 as list, x from v qualify list < (select greatest(1, least(floor(16 * sqrt(count(*))), count(*) // 39)) from v))"


@query(f"with v as (select vec_id, {_E} as x from embeddings), {_NEAR}, d as (select v.vec_id, c.list, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v cross join c) select vec_id, cast(arg_min(list, struct_pack(d := d, l := list)) as integer) as list from d group by vec_id")
def ivf_assign(spark, sf_dir):
    """Every vector's list, before the centroids are trained."""
    v = _vectors(spark, sf_dir)
    return ix.assign(v, ix.first_centroids(v, ix.lists_of(v), "vec_id", "x"), "x").select("vec_id", "list")


_NEIGHBOURS = f"with v as (select vec_id, {_E} as x from embeddings), d as (select q.vec_id as query, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)"


@query(f"{_NEIGHBOURS} select query, cast(rank as integer) as rank, vec_id, round(distance, 6) as distance from (select *, row_number() over (partition by query order by distance, vec_id) as rank from d) where rank <= 3")
def ivf_search(spark, sf_dir):
    """The three nearest neighbours of every hundredth vector, by a trained index of all vectors on disk."""
    v = _vectors(spark, sf_dir)
    folder = own_folder(spark, "index")
    try:
        indexed, lists = ix.write(v, ix.train(v, "vec_id", "x", ix.lists_of(v), 3), "vec_id", "x", folder)
        found = settled(ix.search(indexed, lists, v.where("vec_id % 100 = 0"), "vec_id", "x", 3))
    finally:
        delete(spark, folder)
    return found.select("query", "rank", "vec_id", F.round("distance", 6).alias("distance"))
