"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for candidates of four kinds. The hash of a candidate's value is then counted over the whole corpus by
distinct repositories and distinct owners: a value of up to `owners` owners and `repos` repositories is theirs alone ("live"), one
of more is a widely copied example ("copied"). Candidates of the first three kinds are always reported; an opaque token is reported if it is live
and lies outside the others.

Offsets are code points, the end exclusive. Matches of a kind are leftmost and don't overlap; kinds may. Null and empty texts
have no spans. A null owner or repository counts as one of its own. Repeated rows are reported each, and their values count
once for each owner. An empty table gives an empty one. Extra columns are kept only when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, settle


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind: (pattern, group of the value, least length of the value)
KINDS = {
    "assign": (f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    "opaque": ("(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: Owners, and repositories, that a value may have and still be theirs alone.
OWNERS, REPOS = 2, 4
def has_candidates(text: Column) -> Column:
    """Whether there may be candidates: every access and hex candidate is an opaque run too, and an assignment needs its sign."""
    return (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(KINDS["assign"][0]) | text.rlike(KINDS["opaque"][0])


def matches(text: Column) -> Column:
    """array<struct<kind, i, gap, size, fits, hash>> of the matches of every kind: i counts the matches of a kind, gap is the length
    of what lies between a match and the one before."""

    def of_kind(k: int, pattern: str, group: int, least: int) -> Column:
        whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
        gaps = F.transform(F.split(text, pattern, -1), F.length)

        def told(x: Column, i: Column) -> Column:
            v = x["value"]
            fits = F.length(v) >= least
            if k == len(BASE):
                fits = (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 4)
            hashed = F.sha2(F.regexp_replace(v, "[.=]+$", ""), 256)
            return F.struct(F.lit(k).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["whole"]).alias("size"), fits.alias("fits"), hashed.alias("hash"))

        # the last part follows the last match
        return F.filter(F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), told), lambda x: x["size"].isNotNull())

    return F.concat(*(of_kind(k, *kind) for k, kind in enumerate(KINDS.values())))


def with_places(found: DataFrame, uid: str, of: str = "m") -> DataFrame:
    """(uid, start, kind, end, hash) of the matches that count, from rows (uid, one match): a match fits, and an opaque one lies
    outside of the others. Places are running sums over the matches of a text in order, so work grows with their number alone."""
    in_order = Window.partitionBy(uid, "kind").orderBy("i")
    m = found.select(uid, f"{of}.*")
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_order).cast("int")).where("fits")
    m = m.select(uid, (F.col("end") - F.col("size")).alias("start"), "kind", "end", "hash")
    base = F.col("kind") < len(BASE)
    up, down = Window.partitionBy(uid).orderBy("start"), Window.partitionBy(uid).orderBy(F.desc("start"))
    # of the base spans that begin no later, the one that reaches furthest; of those that begin no earlier, the first
    m = m.withColumn("_before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("_behind", F.min(F.when(base, F.col("start"))).over(down))
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("_behind") >= F.col("end"), F.lit(True))
    return m.where(base | free).drop("_before", "_behind")


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", owner: Column | None = None, repo: Column | None = None, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """The columns in keep and `spans`: array<struct<start, kind, end, hash, n_repos, n_owners, live, reach>> of what is reported, in
    order; reach is the furthest end of the spans before.

    Rows without candidates go straight through; only the others' spans are dealt out, by row, by value and by row again. A value of
    many rows is one row for each repository before it is counted, and joins split its rows over tasks.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    uid, o, r, found = fresh(docs, "_uid", "_owner", "_repo", "_found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.where(has_candidates(text)).withColumns({o: owner.cast("string"), r: repo.cast("string"), uid: F.monotonically_increasing_id()})
    some = settle(some.select(*keep, o, r, uid, matches(text).alias(found)))
    each = settle(with_places(some.select(uid, F.explode(found).alias("m")), uid))
    owned = each.select(uid, "hash").distinct().join(some.select(uid, o, r), uid).select("hash", o, r).distinct()
    # a struct, so that a null counts
    counts = owned.groupBy("hash").agg(F.count_distinct(F.struct(o, r)).alias("n_repos"), F.count_distinct(F.struct(o)).alias("n_owners"))
    live = (F.col("n_owners") <= owners) & (F.col("n_repos") <= repos)
    judged = each.join(counts, "hash").withColumn("live", live).where((F.col("kind") < len(BASE)) | F.col("live"))
    before = Window.partitionBy(uid).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    by_row = judged.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_repos", "n_owners", "live", "reach"))).alias("spans"))
    kind = by_row.schema["spans"].dataType.simpleString()
    nothing = F.expr(f"cast(array() as {kind})")
    kept = some.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(uid).alias("_uid"))
    told = kept.join(by_row.withColumnRenamed(uid, "_uid"), "_uid", "left").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("spans", nothing).alias("spans"))
    return docs.where(~has_candidates(text)).select(*keep, nothing.alias("spans")).unionByName(told)


def redact(text: Column, spans: Column, size: int = 512) -> Column:
    """text with each reported span replaced; spans that overlap become one mark. Widely copied examples get a mark of their own.

    The text is cut into blocks of `size` characters once, as finding a character counts those before it; a piece between marks is
    what it needs of its first and last block and the blocks between.
    """

    def marked(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / size).cast("int"), F.floor((b - 1) / size).cast("int")
            block = lambda i: F.element_at(blocks, i + 1)
            at = a - first * size + 1
            inside = F.substring(block(first), at, b - a)
            across = F.concat(F.substring(block(first), at, F.lit(size)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(block(last), F.lit(1), b - last * size))
            return F.when(b <= a, "").when(first == last, inside).otherwise(across)

        heads = F.filter(spans, lambda x: x["start"] >= x["reach"])
        parts = F.transform(heads, lambda x: F.concat(piece(x["reach"], x["start"]), F.when(x["live"], "[secret]").otherwise("[example secret]")))
        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), piece(end, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), marked))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
