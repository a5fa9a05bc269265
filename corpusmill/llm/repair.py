"""Repair of conversations: faults by windows, then one fold over the sorted turns that finds the cheapest edits.

A conversation is legal if its roles' initials spell nothing, or an optional s and then ua once or more. The fold carries four states,
by what the last turn left is: none yet, system, user, assistant. Each holds the least (cost, audit), where the audit has an initial for
each edit. A turn is kept, given a role, or deleted; empty turns may be inserted before the first and after every turn, so all
states are brought up to date by inserts each time. Of equally cheap edits the ASCII-least audit wins: audits of one cost that have
dealt with equally many turns are never the beginning of one another, as what comes on top would be inserts, which cost; so the least
may be taken at every turn.

Everything is a DataFrame function. Turns go in the order of (turn, role, text), nulls first; null roles and texts are a space, and a
role's initial is its first character, in the case that it has. Repeated rows are turns of their own, and duplicates of the first.
Rows without conv_id are one conversation. A conversation is put together in one row, as its audit and the digest of its repaired text
ask for; the bytes copied while folding grow with the square of its turns. An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
_NEVER = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
STATES = ("none", "system", "user", "assistant")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the check sum of `conv_id:turn`. Dropped rows stay, as gone, so that their
    conversation does."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), x.alias("x"))
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("x") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("x") == 0).alias("gone"), F.when(F.col("x") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def faults(turns: DataFrame) -> DataFrame:
    """turns of (conv_id, turn, role, text, gone) with `at`, the place in the conversation, `first`, the role's initial, `fresh`, whether
    no turn before has its number, `illegal`, whether it can't follow the turn before, and `fault`: blank, duplicate or truncated, the
    first that holds. All windows share one exchange by conv_id."""
    order = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("at")
    rows = turns.withColumn("first", F.substring("role", 1, 1)).withColumns({"at": F.row_number().over(order), "before": F.lag("first").over(order), "last": F.lag("turn").over(order)})
    rows = rows.withColumn("again", F.row_number().over(same) > 1).withColumn("end", F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1)))
    fault = F.when(F.col("end") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "first").isin("su", "ua", "au")
    number = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last"))
    return rows.select("conv_id", "turn", "role", "text", "gone", "at", "first", number.alias("fresh"), illegal.alias("illegal"), fault.alias("fault"))


def _edit(state: Column, cost: Column | int, initial: Column | str) -> Column:
    cost, initial = (x if isinstance(x, Column) else F.lit(x) for x in (cost, initial))
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], initial).alias("audit"))


def _with_inserts(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four states, with inserts where they are cheaper."""
    user = F.least(user, _edit(F.least(none, system, assistant), INSERT, "I"))
    return let(F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant")), lambda x: x.withField("assistant", F.least(x["assistant"], _edit(x["user"], INSERT, "I"))))


def _step(now: Column, turn: Column) -> Column:
    """What a turn makes of the states."""
    first, stays = turn["first"], ~turn["fault"].isin("blank", "duplicate")
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    dropped = {s: _edit(now[s], DELETE, "D") for s in STATES}

    def become(source: Column, initial: str) -> Column:
        own = first == initial
        return _edit(source, extra + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise("R"))

    system = F.when(stays & (first == "s"), F.least(dropped["system"], _edit(now["none"], extra, "K"))).otherwise(dropped["system"])
    user = F.when(stays, F.least(dropped["user"], become(F.least(now["none"], now["system"], now["assistant"]), "u"))).otherwise(dropped["user"])
    assistant = F.when(stays, F.least(dropped["assistant"], become(now["user"], "a"))).otherwise(dropped["assistant"])
    moved = F.struct(dropped["none"].alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))
    return let(moved, lambda m: _with_inserts(*(m[s] for s in STATES)))


def cheapest(turns: Column) -> Column:
    """struct(cost, audit) of sorted turns of (first, fault)."""
    state = lambda cost, audit: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))
    start = F.struct(state(0, "").alias("none"), state(_NEVER, "").alias("system"), state(INSERT, "I").alias("user"), state(2 * INSERT, "II").alias("assistant"))
    return F.aggregate(turns, start, _step, lambda x: F.least(x["none"], x["assistant"]))


def repaired(turns: Column, audit: Column) -> Column:
    """`role:text` of every turn that an audit leaves of sorted turns of (role, text), line by line. Each turn has a letter, with the
    inserts before it; what stays alternates, so roles follow from places."""
    letters = F.regexp_extract_all(audit, F.lit("I*[DKR]"), F.lit(0))
    line = lambda given, role, text: F.struct(given.alias("given"), role.alias("role"), text.alias("text"))
    added = line(F.lit(True), F.lit(""), F.lit(""))
    some = lambda n: F.array_repeat(added, n)
    own = lambda t, x: F.when(x.endswith("D"), some(F.lit(0))).otherwise(F.array(line(x.endswith("R"), t["role"], t["text"])))
    left = F.concat(F.flatten(F.zip_with(turns, letters, lambda t, x: F.concat(some(F.length(x) - 1), own(t, x)))), some(F.length(audit) - F.length(F.rtrim(audit, F.lit("I")))))

    def lines(x: Column) -> Column:
        led = F.coalesce(~F.get(x, F.lit(0))["given"] & (F.substring(F.get(x, F.lit(0))["role"], 1, 1) == "s"), F.lit(False)).cast("int")
        return let(led, lambda n: F.array_join(F.transform(x, lambda y, j: F.concat(F.when(y["given"], F.when((j - n) % 2 == 0, "user").otherwise("assistant")).otherwise(y["role"]), F.lit(":"), y["text"])), "\n"))

    return let(left, lines)


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text, gone): counts of faults, the cheapest edits, the repaired text."""
    there = ~F.col("gone")
    turn = F.when(there, F.col("turn"))
    count = lambda test: F.coalesce(F.sum(F.when(there & test, 1)), F.lit(0)).cast("long")
    whole = faults(turns).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("fresh")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(there, F.struct("at", "first", "fault", "role", "text")))).alias("turns"),
    )
    folded = whole.withColumn("best", cheapest(F.transform("turns", lambda t: F.struct(t["first"].alias("first"), t["fault"].alias("fault")))))
    return folded.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best")["cost"].alias("cost"), F.col("best")["audit"].alias("audit"), repaired(F.col("turns"), F.col("best")["audit"]).alias("repaired"))
