"""Conversation repair by lightest derivations: the cheapest edits that make turns alternate.

A repair is a derivation over items ``(i, state)``: the first ``i`` turns are dealt with, and
the roles so far end in ``state``.  An item and an edit of turn ``i`` deduce the next item;
its weight is the pair (cost, audit), the audit being the initials of the edits so far.  The
agenda pops the least pair, which is then final (Knuth 2008, as Dijkstra on hypergraphs): an
edit adds to the cost or, at no cost, to the audit, and of two audits of one item with one
cost neither begins the other, so what follows keeps their order.

A conversation need not fit one task.  Rows are sorted over the whole table and cut into
chunks.  A chunk that may start inside a conversation is solved from every state; chunks are
then deductions of their own, of which a second agenda picks one each.  That pass reads no
text, and only a bit more than the audits.  Picked chunks are edited where they are.

Edits: Keep; Rerole to user or assistant, 3; Delete, 4, the only one for blank and
duplicate turns; Insert an empty user or assistant turn, 3; a truncated turn that stays adds 3.
The roles of a repaired conversation are those of ``(s?(ua)+)?`` by their initials.

Defined results: nulls are one space; turns are in order of turn (nulls first), role and
text; a role is judged by its first character, and one without characters fits nowhere; rows
of a null conversation are one conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import BLANKS, arrow_schema, small_batches, stored, to_batch

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
# States: nothing yet, after a system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The role that alternation asks for next.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (EMPTY, ASSISTANT)
LEGAL = frozenset(["su", "ua", "au"])

CHUNK_ROWS = 200
CHUNK_CHARS = 1 << 20

Weight = tuple[int, str]
Turn = tuple[str, int]  # initial of the role, fault


def lightest(start: Weight, item: tuple, deductions: Callable, is_goal: Callable, goals: int) -> dict:
    """Weights of the first ``goals`` goal items that the agenda finalises.

    ``deductions(item)`` gives (conclusion, cost, edits) of the deductions that ``item`` is a premise of.
    """
    agenda, final, found = [(*start, item)], {}, {}
    while agenda and len(found) < goals:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if is_goal(item):
            found[item] = (cost, audit)
        for conclusion, more, edits in deductions(item):
            if conclusion not in final:
                heapq.heappush(agenda, (cost + more, audit + edits, conclusion))
    return found


def turn_edits(state: int, turn: Turn) -> Iterator[tuple[int, int, str]]:
    """What can be done with a turn: the state after it, the cost, the edit."""
    initial, fault = turn
    yield state, DELETE_COST, DELETE
    if fault in (BLANK, DUPLICATE):
        return
    stays = TRUNCATED_COST if fault == TRUNCATED else 0
    if (state, initial) in KEPT:
        yield KEPT[state, initial], stays, KEEP
    yield NEXT[state], stays + REROLE_COST, REROLE


def lightest_ends(turns: list[Turn], state: int, whole: bool) -> dict[int, Weight]:
    """For each state that ``turns`` can end in, from ``state``: the lightest weight.

    Of a ``whole`` conversation only the lightest end that is allowed.
    """
    n = len(turns)

    def deductions(item):
        at, current = item
        yield (at, NEXT[current]), INSERT_COST, INSERT
        if at < n:
            for after, cost, edit in turn_edits(current, turns[at]):
                yield (at + 1, after), cost, edit

    ends = GOALS if whole else STATES
    found = lightest((0, ""), (0, state), deductions, lambda item: item[0] == n and item[1] in ends, 1 if whole else len(STATES))
    return {end: weight for (_, end), weight in found.items()}


def replay(rows: list[tuple[str, str]], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """The turns (edit, role, text) that the edits of ``audit`` make of ``rows`` (role, text)."""
    at = 0
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            yield edit, NAMES[state], ""
            continue
        role, text = rows[at]
        at += 1
        if edit == KEEP:
            state = KEPT[state, role[:1]]
            yield edit, role, text
        elif edit == REROLE:
            state = NEXT[state]
            yield edit, NAMES[state], text


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by the checksum of conversation and turn."""
    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), kind.alias("kind")
    )
    return (
        rows.where("kind <> 0")
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"))
    )


def faulty_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n, fault``: equal turns once, with their number.

    ``fault`` is that of the first of the ``n``; if it is no blank the others are duplicates.
    """
    once = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    kinds = once.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    firsts = kinds.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("place"))
    firsts = firsts.select(*[F.col(name).alias(f"first_{name}") for name in ("conv_id", "role", "digest")], F.col("place.turn").alias("first_turn"))
    # Equal in all four, which no two rows are, so that no key is hot.
    same = [F.col(name).eqNullSafe(F.col(f"first_{name}")) for name in ("conv_id", "turn", "role", "digest")]
    first = F.col("first_role").isNotNull()
    blanks = f"[{BLANKS}]"
    stripped = F.regexp_replace("text", f"{blanks}+$", "")
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), BLANK).when(~first, DUPLICATE)
        .when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    )
    joined = kinds.join(firsts, same[0] & same[1] & same[2] & same[3], "left")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


ITEM = "struct<enter:int,leave:int,cost:bigint,audit:string>"
CHUNK = (
    "conv_id {conv}, part int, seq int, rows array<struct<role:string,text:string>>, n_rows bigint, first_turn bigint, last_turn bigint,"
    " n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string,"
    f" items array<{ITEM}>"
)


def chunks(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of the sorted rows of ``faulty_turns``, each with its lightest items; see CHUNK."""
    order = ["conv_id", "turn", "role"]
    ranged = turns.repartitionByRange(*order, F.expr("left(text, 32)")).sortWithinPartitions(*order, "text")
    numbered = ranged.select("conv_id", "turn", "role", "text", "n", "fault", F.spark_partition_id().alias("part"))
    schema = CHUNK.format(conv=dict(turns.dtypes)["conv_id"])
    arrow = arrow_schema(turns, schema)

    def expanded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for conv, turn, role, text, n, fault, part in zip(*(column.to_pylist() for column in batch.columns)):
                yield conv, turn, role, text, fault, part
                for _ in range(n - 1):
                    yield conv, turn, role, text, fault if fault == BLANK else DUPLICATE, part

    def chunk(rows: list[tuple], seq: int, begins: bool, ends: bool) -> tuple:
        turns = [(role[:1], fault) for _, _, role, _, fault, _ in rows]
        numbers = [turn for _, turn, *_ in rows if turn is not None]
        faults = [fault for _, fault in turns]
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(turns, turns[1:]))
        items = [
            (enter, leave, *weight)
            for enter in ((EMPTY,) if begins else STATES)
            for leave, weight in lightest_ends(turns, enter, begins and ends).items()
        ]
        return (
            rows[0][0], rows[0][5], seq, [(role, text) for _, _, role, text, *_ in rows], len(rows), min(numbers, default=None),
            max(numbers, default=None), len(set(numbers)), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
            illegal, turns[0][0], turns[-1][0], items,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first and the last conversation of a partition may lie in others too.
        held: list[tuple] = []
        out: list[tuple] = []
        size = written = seq = 0
        begins = False
        for row in expanded(batches):
            other = bool(held) and row[0] != held[0][0]
            if other or len(held) >= chunk_rows or size >= CHUNK_CHARS:
                out.append(chunk(held, seq, begins, other))
                held, size, seq, begins = [], 0, seq + 1, other
            held.append(row)
            size += len(row[3])
            written += len(row[3]) + 100
            if written >= CHUNK_CHARS and out:
                yield to_batch(out, arrow)
                out, written = [], 0
        if held:
            out.append(chunk(held, seq, begins, False))
        if out:
            yield to_batch(out, arrow)

    return stored(small_batches(numbered).mapInArrow(run, schema), "repair-chunks")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
CHOICE = "part int, seq int, enter int, leave int"
REPORT = "conv_id {conv}, found boolean, " + ", ".join(f"{name} bigint" for name in COUNTS) + ", audit string"


def choices(chunked: DataFrame) -> DataFrame:
    """Which item of each chunk the lightest derivation takes, and a report per conversation.

    Rows with ``part`` name an item, those without are reports.
    """
    summaries = chunked.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = REPORT.format(conv=dict(chunked.dtypes)["conv_id"]) + ", " + CHOICE
    arrow = arrow_schema(chunked, schema)

    def goal(remainders: dict[int, Weight]) -> int:
        # Turns may be inserted behind the last chunk too; its items hold that already.
        return min((state for state in remainders if state in GOALS), key=lambda state: remainders[state])

    def solved(conv, chunks: Iterator[dict]) -> Iterator[tuple]:
        counts = dict.fromkeys(COUNTS, 0)
        # Of the lightest items up to here: cost, and the audit beyond what all of them begin with.
        weights: dict[int, Weight] = {EMPTY: (0, "")}
        common: list[str] = []
        back: list[tuple[int, int, dict[int, int]]] = []
        low = high = last = None
        n_turns = 0
        for one in chunks:
            reached: dict[int, tuple[int, str, int]] = {}
            for item in one["items"]:
                if item["enter"] in weights:
                    cost, audit = weights[item["enter"]]
                    weight = (cost + item["cost"], audit + item["audit"], item["enter"])
                    reached[item["leave"]] = min(reached.get(item["leave"], weight), weight)
            back.append((one["part"], one["seq"], {leave: enter for leave, (_, _, enter) in reached.items()}))
            shared = commonprefix([audit for _, audit, _ in reached.values()])
            common.append(shared)
            weights = {leave: (cost, audit[len(shared) :]) for leave, (cost, audit, _) in reached.items()}

            for name in ("blank", "duplicate", "truncated", "illegal"):
                counts[name] += one[name]
            if last is not None and last + one["first"] not in LEGAL:
                counts["illegal"] += 1
            last = one["last"]
            if one["n_turns"]:
                n_turns += one["n_turns"] - (high == one["first_turn"])
                low = one["first_turn"] if low is None else low
                high = one["last_turn"]
        state = goal(weights)
        counts["cost"] = weights[state][0]
        counts["gaps"] = high - low + 1 - n_turns if n_turns else 0
        yield conv, True, *counts.values(), "".join(common) + weights[state][1], None, None, None, None
        for part, seq, entered in reversed(back):
            yield (conv, False, *[None] * len(COUNTS), None, part, seq, entered[state], state)
            state = entered[state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in grouped_rows(batches):
            out.extend(solved(conv, rows))
            if len(out) >= 5_000:
                yield to_batch(out, arrow)
                out = []
        if out:
            yield to_batch(out, arrow)

    return stored(small_batches(summaries).mapInArrow(run, schema), "repair-choices")


def grouped_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Each conversation of sorted batches with an iterator over its rows, to be read in turn."""
    rows = (row for batch in batches for row in batch.to_pylist())
    ahead = next(rows, None)

    def group(conv):
        nonlocal ahead
        while ahead is not None and ahead["conv_id"] == conv:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        conv = ahead["conv_id"]
        members = group(conv)
        yield conv, members
        for _ in members:
            pass


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and a report of conversations with rows.

    Turns are ``conv_id, part, seq, place, edit, role, text`` in the order of the three
    numbers; deleted ones are left out.  A report is ``conv_id`` and gaps, blank, duplicate,
    truncated, illegal, cost, audit.  ``turns`` has ``conv_id, turn, role, text``.
    """
    chunked = chunks(faulty_turns(turns), chunk_rows)
    chosen = choices(chunked)
    report = chosen.where("found").drop("found", "part", "seq", "enter", "leave")
    taken = chosen.where("NOT found").select("part", "seq", "enter", "leave")
    wanted = chunked.select("conv_id", "part", "seq", "rows", "items").join(taken, ["part", "seq"])
    audit = F.filter("items", lambda i: (i["enter"] == F.col("enter")) & (i["leave"] == F.col("leave")))
    ready = wanted.select("conv_id", "part", "seq", "rows", "enter", F.get(audit, F.lit(0)).getField("audit").alias("audit"))
    conv = dict(chunked.dtypes)["conv_id"]
    schema = f"conv_id {conv}, part int, seq int, place int, edit string, role string, text string"
    arrow = arrow_schema(chunked, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = replay([(turn["role"], turn["text"]) for turn in row["rows"]], row["enter"], row["audit"])
                out = [(row["conv_id"], row["part"], row["seq"], place, *turn) for place, turn in enumerate(made)]
                if out:
                    yield to_batch(out, arrow)

    return small_batches(ready).mapInArrow(run, schema), report


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the turns as ``role:text`` lines; read in order, never held whole."""
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "place").select("conv_id", "role", "text")
    schema = f"conv_id {dict(repaired.dtypes)['conv_id']}, repaired_sha256 string"
    arrow = arrow_schema(repaired, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in grouped_rows(batches):
            digest, between = hashlib.sha256(), ""
            for row in rows:
                digest.update(f"{between}{row['role']}:{row['text']}".encode())
                between = "\n"
            out.append((conv, digest.hexdigest()))
            if len(out) >= 5_000:
                yield to_batch(out, arrow)
                out = []
        if out:
            yield to_batch(out, arrow)

    return small_batches(ordered).mapInArrow(run, schema)


def repair_report(conversations: DataFrame, turns: DataFrame, conv: str = "conv_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row for each id of ``conversations``: faults, cost and audit of the repair of ``turns``, digest of the result."""
    repaired, report = repair(turns, chunk_rows)
    ids = conversations.select(F.col(conv).alias("conv_id")).distinct()
    found = report.withColumnRenamed("conv_id", "of")
    digests = conversation_digests(repaired).withColumnRenamed("conv_id", "for")
    whole = ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("for")), "left")
    return whole.select(
        "conv_id",
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
