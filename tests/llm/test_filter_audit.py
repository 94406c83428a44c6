import random
import re
from contextlib import contextmanager
from itertools import permutations

from pyspark.sql import functions as F

from emberline.llm import filter_audit as f

LABELS = "doc_id long, quality int, toxic int, n int"


def masks(rows):
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }
        out.append((doc_id, source or "", {letter for letter, bad in failed.items() if bad}))
    return out


def brute(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    out = {}
    docs = masks(rows)
    for part in {part for _, part, _ in docs}:
        mine = [(i, failed) for i, p, failed in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in permutations("ABCDE"):
            alive = mine
            for step, letter in enumerate(order, 1):
                removed = [i for i, failed in alive if letter in failed]
                gone = len(mine) - len(alive)
                kept = [(i, failed) for i, failed in alive if letter not in failed]
                redundant = sum(letter in failed for _, failed in mine) - len(removed)
                assert gone + len(removed) + len(kept) == len(mine)
                found["".join(order), step] = (
                    len(kept), len(removed), redundant, sum(failed == {letter} for _, failed in mine),
                    sum(i in good for i in removed), sum(i in toxic for i in removed),
                )
                shapley[letter] += len(removed)
                alive = kept
        out |= {(part, order, step): (*numbers, shapley[order[step - 1]]) for (order, step), numbers in found.items()}
    return out


def result(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(row.part, row.filter_order, row.step): tuple(row[name] for name in names) for row in df.collect()}


def text(r):
    words = [r.choice(["alpha", "Beta", "gamma", "DELTA", "a#b"] + [f"w{i}" for i in range(r.choice([1, 400]))]) for _ in range(r.choice([0, 5, 150, 260]))]
    return " ".join(words) + r.choice(["", " ", " $", "\n"])


def test_against_every_order_one_by_one(spark, make_docs):
    r = random.Random(4)
    texts = [text(r) for _ in range(25)] + [None, ""]
    rows = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["x", "y", None, ""])) for _ in range(120)]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    docs = make_docs(rows, clashing=True)
    marked = spark.createDataFrame([(*label, 5) for label in labels], LABELS)
    found = result(f.audit(spark, docs, marked))
    assert len(found) == 600 * 3
    assert found == brute(rows, labels)


def test_empty_tables_and_a_group_of_copies(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    assert f.audit(spark, make_docs([]), none).count() == 0
    long_text = "Word " * 100_000
    rows = [(i, "copy", f"s{i % 2}") for i in range(50)] + [(99, long_text, "s0"), (99, long_text, "s0"), (100, long_text, "s1")]
    assert result(f.audit(spark, make_docs(rows), none)) == brute(rows, [])


@contextmanager
def no_broadcast(spark):
    """Whatever the driver gathers to broadcast is too large."""
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "1b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def test_labels_are_not_gathered_by_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, None, 5) for i in range(40)], LABELS).write.parquet(f"{tmp_path}/labels")
    rows = spark.range(50).select(F.expr("if(id < 45, id, null) AS id"), F.expr("unhex(sha2(string(id % 7), 256)) AS digest"))
    rows.write.parquet(f"{tmp_path}/rows")
    with no_broadcast(spark):
        marked = f._labelled(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/labels"), "doc_id").collect()
    assert len(marked) == 50
    assert all((row.good, row.toxic) == (int(row.id is not None and row.id < 40 and row.id % 2), 0) for row in marked)


def test_cells_are_not_gathered_by_the_driver(spark):
    cells = spark.range(50).select(
        F.concat(F.lit("part "), "id").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask"),
        *[F.lit(n).cast("long").alias(name) for name, n in (("n", 3), ("good", 2), ("toxic", 1))],
    )
    with no_broadcast(spark):
        steps = f.prefix_steps(cells, "AB")
    assert steps.count() == 50 * 4
    assert {tuple(row)[1:] for row in steps.collect()} == {
        (prefix, prefix[-1], len(prefix), *numbers)
        for prefixes, numbers in ((("A", "B"), (48, 48, 0, 3, 32, 16)), (("AB", "BA"), (24, 24, 24, 3, 16, 8)))
        for prefix in prefixes
    }


def test_orders_are_not_gathered_by_the_driver(spark, plan_of):
    cells = spark.createDataFrame([("x", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    plan = plan_of(f.audit_orders(f.prefix_steps(cells)))
    assert re.search(r"SortMergeJoin \[part#\d+, prefix#\d+\]", plan)
    assert not re.search(r"BroadcastHashJoin \[part#\d+, prefix#\d+\]", plan)
