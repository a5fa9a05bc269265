"""Quotation linking against a plain reading of generated mail."""

import random
import re
import time

from pyspark.sql import functions as F

from corpusmill.llm import quotes


def plain(messages):
    """(answers, thread, depth, place, own) of the messages (turn, text) of one conversation, by the rules as they are told."""
    tidy = lambda t: " ".join(t.lower().split())
    said, parsed = {}, {}
    for turn, text in messages:
        runs = []
        for line in text.split("\n"):
            mark = re.match(r"(?: *>)+", line)
            depth = mark.group().count(">") if mark else 0
            line = re.sub(r"^(?: *>)+ ?", "", line)
            if runs and runs[-1][0] == depth:
                runs[-1][1].append(line)
            else:
                runs.append((depth, [line]))
        parsed[turn] = runs
        for depth, lines in runs:
            if depth == 0:
                for unit in [*lines, "\n".join(lines)]:
                    said[tidy(unit)] = min(said.get(tidy(unit), turn), turn)
    answers = {}
    for turn, runs in parsed.items():
        found = {}
        for depth, lines in runs:
            if depth:
                for unit in ["\n".join(lines), *(x for x in lines if len(tidy(x).split(" ")) >= 3 or len(tidy(x)) >= 8)]:
                    at = said.get(tidy(unit)) if tidy(unit) else None
                    if at is not None and at < turn:
                        found.setdefault(depth, []).append(at)
        answers[turn] = max(found[min(found)]) if found else None
    out, below = {}, {}
    for turn in sorted(answers):
        below.setdefault(answers[turn], []).append(turn)

    def visit(turn, thread, depth):
        runs = parsed[turn]
        own = "\n".join(x for d, lines in runs if d == 0 for x in lines)
        out[turn] = (answers[turn], thread, depth, len(out) + 1, own.strip(" ") if any(d for d, _ in runs) else own)
        for child in below.get(turn, ()):
            visit(child, thread, depth + 1)

    for top in below.get(None, ()):
        visit(top, top, 0)
    return out


def test_places_of_generated_mail(spark):
    rng = random.Random(12)
    rows = []
    for conv, (n, back) in enumerate([(1, 1), (40, 1), (60, 60), (80, 5), (50, 50), (30, 30)]):
        texts = []
        for turn in range(n):
            own = [f"message {conv} {turn} {rng.choice(['yes', 'No', 'Perhaps'])}", "short"] + [f"more of {turn} é{rng.randrange(9)}"] * rng.randrange(3)
            quoted = []
            if texts and rng.random() < 0.85:
                other = rng.choice(texts[-back:]) if conv < 4 else texts[0]
                # of what is quoted, its own quotes are one deeper
                quoted = [(">" if x.startswith(">") else "> ") + x.replace("e", "E") for x in other.split("\n")][: rng.randrange(1, 9)]
            texts.append("\n".join([*own[:1], *quoted, *own[1:]] if rng.random() < 0.3 else [*quoted, *own]))
        rows += [(conv, turn * 2, "user", t) for turn, t in enumerate(texts)]
    frame = spark.createDataFrame(rows + [(None, 1, "user", "> x"), (2, None, "user", "y"), (3, 0, "again", rows[101][3])], "conv_id long, turn long, role string, text string").withColumn("earlier", F.lit(0))
    linked = quotes.link(frame)
    got = {(r.conv_id, r.turn): r for r in linked.where("role <> 'again'").collect()}
    n_linked = 0
    for conv in range(6):
        want = plain([(t, x) for c, t, _, x in rows if c == conv])
        for turn, w in want.items():
            r = got[conv, turn]
            assert (r.answers, r.thread, r.depth, r.place, r.text) == w
            n_linked += w[0] is not None
    assert n_linked > 150 and got[None, 1].place is None and got[2, None].place is None
    in_order = quotes.in_reply_order(linked.where("conv_id = 3 AND role = 'user'")).collect()
    assert [r.place for r in in_order] == list(range(1, 81))
    (again,) = linked.where("role = 'again'").collect()
    assert again.place == got[3, 0].place


def test_one_long_message(spark):
    lines = [f"line {i} of a long message" for i in range(100_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join(f"{'>' * (1 + i % 2)} {x}" for i, x in enumerate(lines))), (1, 2, "user", "\n".join("> " + x for x in lines) + "\nno")]
    start = time.perf_counter()
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("turn", "answers", "n_linked", "n_quotes", "text").collect()}
    assert time.perf_counter() - start < 60
    assert (got[1].answers, got[1].n_linked, got[1].n_quotes, got[1].text) == (0, 100_000, 100_000, "") and (got[2].answers, got[2].n_linked, got[2].text) == (0, 100_001, "no")
