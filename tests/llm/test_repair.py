"""Repaired conversations against trying all edits."""

import random
import re
import zlib

from corpusmill.llm import repair

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        match zlib.crc32(key.encode()) % 20:
            case 0:
                continue
            case 1:
                text = ""
            case 2:
                text = re.sub("[.!?]", "", text)
            case 3:
                out.append((conv, turn, role, text))
            case 4:
                role = "user"
        out.append((conv, turn, role, text))
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain(rows):
    """The cheapest of all edits, by trying them all; inserts go before each row and at the end."""
    seen, marks = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        marks.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    found = []

    def go(i, cost, letters, made):
        roles = "".join(r[:1] or "?" for r, _ in made)
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, letters, "\n".join(f"{r}:{t}" for r, t in made)))
        if letters[-2:] != "II":
            for role in ("user", "assistant"):
                go(i, cost + 5, letters + "I", [*made, (role, "")])
        if i < len(rows):
            go(i + 1, cost + 2, letters + "D", made)
            if marks[i] not in ("blank", "duplicate"):
                extra = 5 * (marks[i] == "truncated")
                role, text = rows[i][2:]
                go(i + 1, cost + extra, letters + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + extra + 1, letters + "R", [*made, (new, text)])

    go(0, 0, "", [])
    turns = [t for _, t, _, _ in rows if t is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, *min(found))


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, FAULT string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damage(frame)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == plain(damaged([r for r in rows if r[0] == conv])), conv


def test_against_all_edits(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "", None, " \t", "half a", "why?\n", "é…", "Yes.", "a. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = [(conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for conv in [None, *range(150)] for _ in range(rng.randrange(1, 5))]
    rows += rows[:10]
    rows = [r for r in rows if sum(x[0] == r[0] for x in rows) <= 5]
    check(spark, rows)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(repair.damage(frame)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", "")]
    assert repair.repair(repair.damage(frame.limit(0))).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}. " + "word " * (5000 if t == 7 else 3) + ".") for t in range(3000)]
    r = repair.repair(repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    left = damaged(rows)
    edits = re.findall("I*[DKR]", r.audit)
    assert len(edits) == len(left) and r.cost == sum({"I": 5, "D": 2, "R": 1, "K": 0}[c] for c in r.audit) + 5 * sum(e[-1] != "D" and x[3].rstrip(WHITE)[-1] not in ".!?" for e, x in zip(edits, left))
    assert re.fullmatch("(ua)+", "".join(line[0] for line in r.repaired.split("\n")))
