"""Chat formatting by quotation linking, in DataFrame functions only.

A line that starts with one or more ">" is a quote, as deep as it has of them; neighbouring lines of one depth are a passage.
Passages are normalised (lower case, white space made one space) and hashed, whole and line by line, and so is what each message
says itself. Whole quoted passages link whatever their length; a single line of a longer passage needs three words or eight
characters. A quoted hash links to the first message of the same conversation that said it, if that came before. A message
answers the latest message that its shallowest linked quotes lead to. Each message is returned without its quotes, with the
message it answers, the first message of its thread, its depth there, its place in the conversation in the order of replies (a
message, then each answer to it by turn with all answers below; from 1), and the text under a role header.

A conversation is never gathered in one task: links are joins of hashes within conversations on one row for each, threads and
places are found by doubling the steps upward and by running sums over ranges. Null texts are empty. Rows without conversation or
turn neither link nor are linked and have no place. Rows that repeat a (conversation, turn) are each returned and share its place
and the latest answer found for it. Messages whose quotes link nowhere start threads of their own. An empty table gives an empty
one; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, settle

#: Words, or characters, of which a single line of a longer quoted passage needs one or the other to link, as shorter ones repeat by chance.
LEAST_WORDS, LEAST_CHARS = 3, 8
_MARK = r"^(?:\x20*>)+"


def passages(text: Column) -> Column:
    """array<struct<depth, lines>>: runs of lines of one quote depth, depth 0 being the message's own."""
    lines = F.split(text, "\n", -1)
    marked = F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 0), "[^>]", "")).alias("depth"),
            F.regexp_replace(x, _MARK + r"\x20?", "").alias("line"),
        ),
    )

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        depth = lambda i: F.element_at(lines, i)["depth"]
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, True).otherwise(depth(i) != depth(F.greatest(i - 1, F.lit(1)))))

        def runs(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n + 1))
            return F.zip_with(starts, ends, lambda a, b: F.struct(depth(a).alias("depth"), F.transform(F.slice(lines, a, b - a), lambda x: x["line"]).alias("lines")))

        return let(starts, runs)

    return let(marked, cut)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _units(found: Column) -> Column:
    """array<struct<depth, hash>> of passages and their lines, each once. Of quotes, lines within a longer passage need some length."""

    def of_passage(p: Column) -> Column:
        text = lambda x: F.struct(p["depth"].alias("depth"), normalised(x).alias("text"))
        lines = F.filter(F.transform(p["lines"], text), lambda x: (x["depth"] == 0) | (F.size(F.split(x["text"], " ")) >= LEAST_WORDS) | (F.length(x["text"]) >= LEAST_CHARS))
        return F.concat(F.array(text(F.array_join(p["lines"], "\n"))), lines)

    texts = F.filter(F.flatten(F.transform(found, of_passage)), lambda x: x["text"] != "")
    # as strings, since arrays of structs are made distinct by comparing each with each
    written = F.array_distinct(F.transform(texts, lambda x: F.concat(F.sha2(x["text"], 256), x["depth"].cast("string"))))
    return F.transform(written, lambda x: F.struct(F.substr(x, F.lit(65)).cast("int").alias("depth"), F.substring(x, 1, 64).alias("hash")))


def running_sum(rows: DataFrame, groups: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the group that come before. A group may be of any size: rows are dealt out by
    ranges of the order, summed within them, and take the sums of the group's ranges before."""
    ranged = settle(rows.repartitionByRange(*groups, order).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy("_p", *groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_p", *groups).agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_before > 0")
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in ("_p", *groups)], "_before")
    same = F.col("_p") == F.col("__p")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    summed = ranged.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
    return summed.join(parts, same, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def climb(links: DataFrame, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of links (conv, turn, up): (conv, turn, thread, depth, far), the top of each linked message, the steps to it and the sum of
    `steps` (conv, turn, step) on the way, without the top's own; and (conv, turn, below), how many stand below each message that any
    stand below. Each round doubles the length of all steps, so there are as many rounds as the depth has binary digits."""
    up = links.select("conv", "turn", F.col("up").alias("thread"), F.lit(1).alias("depth"))
    up = settle(up.withColumn("far", F.lit(0).cast("long")) if steps is None else up.join(steps, ["conv", "turn"]).withColumnRenamed("step", "far"))
    below = links.select("conv", "turn", F.lit(0).cast("long").alias("below")).limit(0)
    length = 1
    while not (reaching := up.where(F.col("depth") == length)).isEmpty():
        if steps is None:
            held = reaching.join(below, ["conv", "turn"], "left").select("conv", F.col("thread").alias("turn"), (1 + F.coalesce("below", F.lit(0))).alias("below"))
            below = settle(below.unionByName(held).groupBy("conv", "turn").agg(F.sum("below").alias("below")))
        above = up.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2"), F.col("far").alias("f2"))
        higher = up.join(above, ["conv", "thread"], "left")
        up = settle(higher.select("conv", "turn", F.coalesce("t2", "thread").alias("thread"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("far") + F.coalesce("f2", F.lit(0))).alias("far")))
        length *= 2
    return up, below


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, own, answers, thread, depth, n_quotes, n_linked, formatted) of every message."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    quoting = F.col("text").rlike(r"(?m)^\x20*>")
    whole = F.array(F.struct(F.lit(0).alias("depth"), F.split("text", "\n", -1).alias("lines")))
    parsed = rows.withColumn("parts", F.when(quoting, passages(F.col("text"))).otherwise(whole))
    own = F.array_join(F.flatten(F.transform(F.filter("parts", lambda p: p["depth"] == 0), lambda p: p["lines"])), "\n")
    parsed = parsed.select("conv", "turn", "role", "parts", F.when(F.exists("parts", lambda p: p["depth"] > 0), F.trim(own)).otherwise(F.col("text")).alias("own"))
    placed = parsed.where("conv IS NOT NULL AND turn IS NOT NULL")
    units = placed.select("conv", "turn", F.explode(_units(F.col("parts"))).alias("u")).select("conv", "turn", "u.depth", "u.hash")
    said = units.where("depth = 0").groupBy("conv", "hash").agg(F.min("turn").alias("said"))
    quoted = units.where("depth > 0").join(said, ["conv", "hash"]).where("said < turn")
    shallow = quoted.groupBy("conv", "turn", "depth").agg(F.max("said").alias("up"), F.count_distinct("hash").alias("n"))
    answers = settle(shallow.groupBy("conv", "turn").agg(F.min_by("up", "depth").alias("answers"), F.sum("n").alias("n_linked")))
    links = answers.select("conv", "turn", F.col("answers").alias("up"))
    tops, below = climb(links)
    # a message's place is that of what it answers, the answers before it with all below them, and itself; starts of threads answer none
    nodes = placed.select("conv", "turn").distinct().join(answers, ["conv", "turn"], "left").join(below, ["conv", "turn"], "left")
    nodes = nodes.withColumn("size", 1 + F.coalesce("below", F.lit(0))).drop("below")
    nodes = running_sum(nodes, ["conv", "answers"], "turn", "size", "earlier")
    if not links.isEmpty():
        nodes = settle(nodes)
    steps = nodes.select("conv", "turn", (F.col("earlier") + 1).alias("step"))
    tops = climb(links, steps)[0] if not links.isEmpty() else tops
    first = steps.select("conv", F.col("turn").alias("thread"), F.col("step").alias("top"))
    tops = tops.join(first, ["conv", "thread"]).select("conv", "turn", "thread", "depth", (F.col("far") + F.col("top")).alias("place"))
    order = nodes.join(tops, ["conv", "turn"], "left").select("conv", "turn", "answers", "n_linked", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("place", F.col("earlier") + 1).alias("place"))
    linked = parsed.join(order, ["conv", "turn"], "left")
    return linked.select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        F.col("own").alias("text"),
        "answers",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "place",
        F.size(F.filter("parts", lambda p: p["depth"] > 0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("formatted"),
    )


def in_reply_order(linked: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What link() gives, dealt out by ranges of (conversation, place) and in that order: the text of a conversation is the column
    `formatted` from row to row. A conversation may stretch over any number of partitions."""
    return linked.repartitionByRange(conv, "place").sortWithinPartitions(conv, "place")
