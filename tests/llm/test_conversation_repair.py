import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from emberline.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq string"
GRAMMAR = re.compile("(s?(ua)+)?")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def faults(rows):
    out = []
    for at, (role, text) in enumerate(rows):
        stripped = text.strip(" \t\n\x0b\x0c\r")
        out.append(c.BLANK if not stripped else c.DUPLICATE if (role, text) in rows[:at] else c.SOUND if stripped[-1] in ".!?" else c.TRUNCATED)
    return out


def cheapest(rows):
    """All edits of all turns with up to one insert between and two at the end."""
    kinds = faults(rows)
    choices = []
    for (role, text), kind in zip(rows, kinds):
        stays = 3 if kind == c.TRUNCATED else 0
        edits = [(4, "D", None)]
        if kind in (c.SOUND, c.TRUNCATED):
            edits += [(stays, "K", (role, text)), (stays + 3, "R", ("user", text)), (stays + 3, "R", ("assistant", text))]
        inserts = [(0, "", None), (3, "I", ("user", "")), (3, "I", ("assistant", ""))]
        choices += [inserts, edits]
    one = [("user", ""), ("assistant", "")]
    choices.append([(0, "", [])] + [(3, "I", [a]) for a in one] + [(6, "II", [a, b]) for a in one for b in one])
    best = None
    for chosen in product(*choices):
        made = [m for _, _, m in chosen[:-1] if m is not None] + chosen[-1][2]
        if GRAMMAR.fullmatch("".join(role[:1] or "-" for role, _ in made)):
            found = (sum(cost for cost, _, _ in chosen), "".join(edit for _, edit, _ in chosen), made)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def ordered(rows):
    return sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))


def brute(rows, ids):
    """Reports of ``rows`` (conv, turn, role, text), already damaged."""
    out = {}
    for conv in ids:
        mine = ordered([row[1:] for row in rows if row[0] == conv])
        turns = [(role, text) for _, role, text in mine]
        kinds = faults(turns)
        numbers = {turn for turn, _, _ in mine if turn is not None}
        initials = [role[:1] for role, _ in turns]
        cost, audit, made = cheapest(turns)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds.count(c.BLANK), kinds.count(c.DUPLICATE),
            kinds.count(c.TRUNCATED), sum(a + b not in c.LEGAL for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{role}:{text}" for role, text in made).encode()).hexdigest(),
        )
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {row.conv_id: tuple(row[name] for name in names) for row in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*row, "p", "s") for row in rows], SCHEMA).repartition(3)


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", ""]
TEXTS = ["Yes.", "No", "", " \n", "What? ", "Go!\n", "é."]


@pytest.mark.parametrize("chunk_rows", [1, 2, 200])
def test_against_all_edits(spark, chunk_rows):
    r = random.Random(chunk_rows)
    rows = [
        (conv, r.choice([None, *range(5)]), r.choice(ROLES), r.choice(TEXTS))
        for conv in [None, *range(25)] for _ in range(r.randrange(1, 4))
    ]
    turns = frame(spark, rows)
    assert result(c.repair_report(turns, turns, chunk_rows=chunk_rows)) == brute(rows, {row[0] for row in rows})


def test_long_conversations_in_chunks_equal_those_in_one(spark):
    r = random.Random(9)
    rows = [(conv, turn, r.choice(ROLES), r.choice(TEXTS + [f"t{turn}.", f"u{turn}"])) for conv in (1, 2) for turn in range(150)]
    turns = frame(spark, rows)
    whole = result(c.repair_report(turns, turns, chunk_rows=1000))
    assert whole == result(c.repair_report(turns, turns, chunk_rows=7))
    for conv, (*_, cost, audit, digest) in whole.items():
        mine = [(role, text) for _, role, text in ordered([row[1:] for row in rows if row[0] == conv])]
        made = list(c.replay(mine, c.EMPTY, audit))
        assert GRAMMAR.fullmatch("".join(role[0] for _, role, _ in made))
        assert digest == hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in made).encode()).hexdigest()
        best = c.lightest_ends([(role[:1], kind) for (role, _), kind in zip(mine, faults(mine))], c.EMPTY, True)
        assert list(best.values()) == [(cost, audit)]


def test_damage_nulls_and_conversations_without_rows(spark):
    r = random.Random(2)
    rows = [
        (conv, r.choice([None, *range(6)]), r.choice([*ROLES, None]), r.choice([*TEXTS, None]))
        for conv in [None, *range(40)] for _ in range(r.randrange(1, 3))
    ]
    conversations = frame(spark, rows)
    found = result(c.repair_report(conversations, c.damaged(conversations)))
    expected = brute(damaged(rows), {row[0] for row in rows})
    assert found == expected
    assert (0, 0, 0, 0, 0, 0, "", EMPTY_HASH) in found.values()
    empty = frame(spark, [])
    assert c.repair_report(empty, c.damaged(empty)).count() == 0


def test_repeated_rows_are_counted_before_they_are_sorted(spark):
    rows = [(7, 1, "user", "Same.")] * 500 + [(7, 2, "assistant", "x" * 3_000_000 + ".")]
    turns = frame(spark, rows)
    (row,) = c.faulty_turns(turns).where("turn = 1").collect()
    assert (row.n, row.fault) == (500, c.SOUND)
    found = result(c.repair_report(turns, turns))
    assert found[7][:7] == (0, 0, 499, 0, 499, 4 * 499, "".join(["K", "D" * 499, "K"]))
