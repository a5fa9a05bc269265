"""The registered queries opN_<name> and what DuckDB says to the same. Each query is thin: an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, editcount, hyperminhash, ordinal, quotes, repair, secrets, simhash, topk, unit_dedup, wordlm
from .common import table


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return out.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.BASE)],
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_copied"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordinal.rate(docs, table(spark, sf_dir, "labels")).select("doc_id", "severity", "grade", "rejected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unit_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), "text")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets three edits at places that follow its length: words inserted, characters deleted, characters replaced."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    edit = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))
    third, half, later = F.floor(n / 3), F.floor(n / 2), F.floor(2 * n / 3)
    docs = docs.withColumn("edits", F.array(edit(third, third, " as edited"), edit(half, half + 16, ""), edit(later, later + 8, "\n\n42 new lines ")))
    return editcount.count_with_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hyperminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair(repair.damage(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_lm_scoring,
        op3_substring_dedup,
        op4_exact_topk,
        op5_toxicity,
        op6_chat_formatting,
        op7_simhash,
        op8_decontamination,
        op9_byte_bpe,
        op10_token_counts,
        op11_filter_audit,
        op12_minhash,
        op13_conversation_repair,
    )
}
_ASSIGN = secrets.KINDS["assign"][0].replace("'", "''")
#: (pattern, group of the value, condition on the value), as RE2 reads it: runs are maximal without a look behind.
_SECRETS = {
    "assign": (_ASSIGN, 2, "length(value) >= 6"),
    "access": ("AKIA[A-Z0-9]+", 0, "length(value) >= 20"),
    "hex": ("[0-9a-f]{24,}", 0, "true"),
    "opaque": ("[A-Za-z0-9_-]{20,}", 0, "length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 and length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 4"),
}
_MATCHES = " union all ".join(
    f"select doc_id, source, lang, {k} as kind, '{name}' as name, string_split_regex(text, '{p}') as b, regexp_extract_all(text, '{p}', 0) as w, regexp_extract_all(text, '{p}', {g}) as v from documents" for k, (name, (p, g, _)) in enumerate(_SECRETS.items())
)
_FITS = " or ".join(f"(kind = {k} and {c})" for k, (_, _, c) in enumerate(_SECRETS.values()))
_STATE = lambda cost, audit: f"{{'c': {cost}, 'a': {audit}}}"
_PLUS = lambda state, cost, initial: _STATE(f"{state}.c + {cost}", f"{state}.a || {initial}")
_END = "[.!?]+[ \\t\\x0b\\x0c\\r]+"
_LOWER = f"translate({{}}, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL: dict[str, str] = {
    "op1_secret_scans": f"""with found as ({_MATCHES}), placed as (select doc_id, source, lang, kind, name, b, w, v, unnest(range(1, len(w) + 1)) as i from found),
spans as (select doc_id, source, lang, kind, name, cast(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as bigint) as start, length(w[i]) as n, v[i] as value from placed),
base as (select * from spans where kind < 3 and ({_FITS})),
free as (select * from spans s where kind = 3 and ({_FITS}) and not exists (select 1 from base t where t.doc_id = s.doc_id and t.start < s.start + s.n and s.start < t.start + t.n)),
every as (select *, regexp_replace(value, '[.=]+$', '') as secret from (select * from base union all select * from free)),
owned as (select secret, count(distinct coalesce(source, '')) <= {secrets.OWNERS} and count(distinct struct_pack(s := coalesce(source, ''), l := coalesce(lang, ''))) <= {secrets.REPOS} as live from every group by secret),
told as (select *, name || ':' || start || ':' || (start + n) as said from every join owned using (secret) where kind < 3 or live),
byid as (select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, coalesce(string_agg(said, ',' order by start, kind) filter (where kind < 3), '') as base, string_agg(said, ',' order by start, kind) as spans, count(*) filter (where live) as n_live, count(*) filter (where not live) as n_copied from told group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied from documents d left join byid using (doc_id)""",
    "op3_substring_dedup": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as ln from documents),
lo as (select *, cast(sum(length(line) + 1) over (partition by doc_id order by ln) - length(line) - 1 as bigint) as at0 from l),
cut as (select doc_id, ln, at0, length(line) as size, string_split_regex(line, '{_END}') as p, list_concat(regexp_extract_all(line, '{_END}'), ['']) as e from lo),
part as (select doc_id, ln, at0, size, list_transform(p, lambda x, i: x || e[i]) as ps from cut),
sent0 as (select doc_id, ln, at0, size, unnest(ps) as st, unnest(list_transform(range(1, len(ps) + 1), lambda i: at0 + coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0))) as start from part),
sent as (select doc_id, ln, at0, size, cast(start as bigint) as start, cast(start + length(st) as bigint) as stop, list_filter(string_split_regex({_LOWER.format('st')}, '[\\t-\\r ]+'), lambda w: w <> '') as w from sent0),
full_sent as (select * from sent where len(w) > 0),
ahead as (select doc_id, start, list(struct_pack(w := w, stop := stop)) over (partition by doc_id order by start rows between current row and 7 following) as nx from full_sent),
ended as (select doc_id, start, nx, list_filter(range(1, len(nx) + 1), lambda k: list_sum(list_transform(nx[1:k], lambda z: len(z.w))) >= {unit_dedup.LEAST_WORDS} or list_sum(list_transform(nx[1:k], lambda z: strlen(array_to_string(z.w, ' ')) + 1)) - 1 >= {unit_dedup.LEAST_BYTES})[1] as k from ahead),
units as (select doc_id, start, nx[k].stop as stop, array_to_string(list_transform(nx[1:k], lambda z: array_to_string(z.w, ' ')), ' ') as x from ended where k is not null
 union all select doc_id, min(at0) as start, min(at0) + min(size) as stop, string_agg(array_to_string(w, ' '), ' ' order by start) as x from full_sent group by doc_id, ln having count(*) > 1 and (sum(len(w)) >= {unit_dedup.LEAST_WORDS} or sum(strlen(array_to_string(w, ' ')) + 1) - 1 >= {unit_dedup.LEAST_BYTES})),
firsts as (select x, min(struct_pack(d := doc_id, s := start, e := stop)) as f from units group by x),
gone as (select distinct doc_id, case when f.d = doc_id then greatest(start, least(f.e, stop)) else start end as start, stop from units join firsts using (x) where struct_pack(d := doc_id, s := start, e := stop) <> f),
spans as (select *, coalesce(max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding), 0) as done from (select distinct * from gone where start < stop)),
told as (select doc_id, count(*) as n_removed, string_agg(start || ':' || stop, ',' order by start, stop) as removed, max(stop) as last, string_agg(substr(text, cast(done + 1 as bigint), cast(greatest(start - done, 0) as bigint)), '' order by start, stop) as kept from spans join documents using (doc_id) group by doc_id)
select d.doc_id, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed, case when n_removed is null then text else kept || substr(text, cast(last + 1 as bigint)) end as text from documents d left join told using (doc_id)""",
    "op4_exact_topk": """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5""",
    "op8_decontamination": f"""with b as (select item_id, {_WORDS} as w from benchmark), cut as (select item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g from cut), sizes as (select distinct n from win),
d as (select doc_id, coalesce({_WORDS}, []) as w from documents), spot as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
occ as (select distinct doc_id, i, a.n, item_id from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from spot) a join win using (n, g)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from occ) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join hit using (doc_id) left join its using (doc_id)""",
    "op11_filter_audit": """with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\\t-\\r ]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as least from t),
f as (select doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as f from w),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as bad from labels group by doc_id),
c as (select part, f, count(*) as n, count(*) filter (where good) as g, count(*) filter (where bad) as x from f left join l using (doc_id) group by part, f),
z as (select unnest(['A', 'B', 'C', 'D', 'E']) as z), orders as (select a.z || b.z || c.z || d.z || e.z as o from z a, z b, z c, z d, z e where len(list_distinct([a.z, b.z, c.z, d.z, e.z])) = 5),
r as (select part, o, step, n, g, x, f[ascii(o[step]) - 64] as here, len(list_filter(range(1, step), lambda i: f[ascii(o[i]) - 64])) > 0 as before, len(list_filter(f, lambda b: b)) = 1 as single from c, orders, (select unnest(range(1, 6)) as step)),
s as (select part, o as filter_order, cast(step as integer) as step, coalesce(sum(n) filter (where not here and not before), 0) as kept, coalesce(sum(n) filter (where here and not before), 0) as removed, coalesce(sum(n) filter (where here and before), 0) as redundant, coalesce(sum(n) filter (where here and single), 0) as unique_fails, coalesce(sum(g) filter (where here and not before), 0) as good_lost, coalesce(sum(x) filter (where here and not before), 0) as toxic_lost from r group by part, o, step)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, cast(sum(removed) over (partition by part, filter_order[step]) as bigint) as shapley from s""",
    "op12_minhash": f"""with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\t-\\r ]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) as g from w where len(w) > 0), n as (select doc_id, count(*) as n from g group by doc_id),
meet as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from meet join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)), way as (select a, b from link union all select b, a from link),
reach(d, e) as (select doc_id, doc_id from documents union select d, b from reach join way on a = e),
c as (select d, min(e) as component_id from reach group by d) select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents join c on d = doc_id left join n using (doc_id)""",
    "op13_conversation_repair": f"""with recursive tbl as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
x as (select k.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as x from k, tbl),
d as (select conv_id, turn, case x when 4 then 'user' else role end as role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(0, case x when 0 then 0 when 3 then 2 else 1 end)) as copy from x),
o as (select conv_id, turn, role, text, role[1] as f, row_number() over c as place, lag(role[1]) over c as before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] as e from d window c as (partition by conv_id order by turn nulls first, role, text)),
g as (select *, row_number() over (partition by conv_id, role, text order by place) > 1 as again from o),
p as (select *, case when e = '' then 'b' when again then 'd' when e not in ('.', '!', '?') then 't' else '' end as fault, case when e not in ('', '.', '!', '?') and not again then 5 else 0 end as extra from g),
q as (select *, fault not in ('b', 'd') as stays, case when f = 'u' then {_STATE('extra', "'K'")} else {_STATE('extra + 1', "'R'")} end as tou, case when f = 'a' then {_STATE('extra', "'K'")} else {_STATE('extra + 1', "'R'")} end as toa from p),
ids as (select distinct conv_id from conversations),
fold(conv_id, place, n, s, u, a) as (select conv_id, 0::bigint, {_STATE('0::bigint', "''")}, {_STATE('1099511627776', "''")}, {_STATE('5::bigint', "'I'")}, {_STATE('10::bigint', "'II'")} from ids union all
 select conv_id, place, n, s, u, list_min([a, {_PLUS('u', 5, "'I'")}]) from (select conv_id, place, n, s, list_min([u, {_PLUS('n', 5, "'I'")}, {_PLUS('s', 5, "'I'")}, {_PLUS('a', 5, "'I'")}]) as u, a from
 (select q.conv_id, q.place, {_PLUS('n', 2, "'D'")} as n, list_min([{_PLUS('s', 2, "'D'")}] || case when stays and q.f = 's' then [{_PLUS('n', 'extra', "'K'")}] else [] end) as s,
 list_min([{_PLUS('u', 2, "'D'")}] || case when stays then [{_PLUS('n', 'tou.c', 'tou.a')}, {_PLUS('s', 'tou.c', 'tou.a')}, {_PLUS('a', 'tou.c', 'tou.a')}] else [] end) as u, list_min([{_PLUS('a', 2, "'D'")}] || case when stays then [{_PLUS('u', 'toa.c', 'toa.a')}] else [] end) as a
 from fold join q on q.conv_id is not distinct from fold.conv_id and q.place = fold.place + 1))),
best as (select conv_id, place as turns, list_min([n, a]) as b from fold qualify row_number() over (partition by conv_id order by place desc) = 1),
ch as (select conv_id, i, b.a[i] as ch, sum((b.a[i] <> 'I')::int) over e as place, sum((b.a[i] <> 'D')::int) over e as j from (select conv_id, b, unnest(range(1, length(b.a) + 1)) as i from best) window e as (partition by conv_id order by i)),
ln as (select ch.conv_id, i, ch, j, coalesce(bool_or(j = 1 and ch = 'K' and f = 's') over (partition by ch.conv_id), false) as led, role, text from ch left join q on q.conv_id is not distinct from ch.conv_id and q.place = ch.place),
said as (select conv_id, string_agg(case when ch = 'K' then role || ':' || text else (case when (j - led::int) % 2 = 1 then 'user:' else 'assistant:' end) || case when ch = 'R' then text else '' end end, chr(10) order by i) as repaired from ln where ch <> 'D' group by conv_id),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated, count(*) filter (where before || f not in ('su', 'ua', 'au')) as illegal from p group by conv_id)
select best.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, b.c::bigint as cost, b.a as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from best left join n on n.conv_id is not distinct from best.conv_id left join said on said.conv_id is not distinct from best.conv_id""",
}
