import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from emberline.llm import components, minhash_dedup as m


def text(r, n=80):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def varied(r, base, edits):
    words = base.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = "z%d" % r.randrange(10**6)
    return " ".join(words)


def brute(rows):
    sets = [(doc_id, set(m.shingles(value).tolist())) for doc_id, value in rows if doc_id is not None]
    parent = {doc_id: doc_id for doc_id, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {doc_id: root(doc_id) for doc_id in parent}


@pytest.mark.parametrize("seed", range(2))
def test_components_against_all_pairs(spark, make_docs, seed):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = text(r)
        for _ in range(r.choice([1, 2, 5, 25])):
            rows.append((n, varied(r, base, r.randrange(0, 4))))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "ONE two"), (n + 4, "two one"), (n + 5, " \n")]
    found = {row.doc_id: row for row in m.near_duplicates(make_docs(rows, clashing=True)).collect()}
    expected = brute(rows)
    assert {k: row.component_id for k, row in found.items()} == expected
    assert all(row.kept == (row.doc_id == row.component_id) for row in found.values())


def test_members_far_from_the_first_are_still_linked(spark, make_docs):
    """A chain: neighbours are similar, its ends are not, and the first document is an end."""
    r = random.Random(5)
    words = text(r, 200).split()
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words)))
        words = words[4:] + text(r, 4).split()
    found = {row.doc_id: row.component_id for row in m.near_duplicates(make_docs(rows)).collect()}
    assert found == brute(rows) and set(found.values()) == {0}


def test_repeated_rows_null_ids_and_empty_tables(spark, make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words than those above here"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    found = sorted((str(row.doc_id), str(row.component_id), row.kept) for row in m.near_duplicates(make_docs(rows)).collect())
    assert found == [("1", "1", True)] * 3 + [("2", "1", False)] + [("None", "None", True)] * 2
    kept = m.without_near_duplicates(make_docs(rows, clashing=True))
    assert sorted(str(row.doc_id) for row in kept.collect()) == ["1", "None", "None"]
    assert m.near_duplicates(make_docs([])).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, make_docs):
    r = random.Random(8)
    bases = [text(r, 60) for _ in range(3)]
    rows = [(i, varied(r, bases[i % 3], 2)) for i in range(60)]
    docs = make_docs(rows)
    buckets = m.signatures(docs).select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    alone = docs.select(F.col("doc_id").alias("member"), F.col("doc_id").alias("component"))
    sets = m.signatures(docs).join(docs.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "node")
    for block in (1000, 7):
        links = m.links_across(buckets, alone, sets, block)
        found = {row.node: row.component for row in components.connected_components(links).collect()}
        assert {i: found.get(i, i) for i, _ in rows} == brute(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {row.node: row.component for row in found.collect()} == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}


@pytest.mark.parametrize("seed", range(4))
def test_repeated_ids_with_unequal_texts_in_any_order_of_rows(spark, make_docs, seed):
    r = random.Random(seed)
    base, other = text(r), text(r)
    rows = [(0, base), (0, other), (1, varied(r, base, 2)), (2, varied(r, base, 3)), (3, varied(r, other, 2)), (4, text(r))]
    for _ in range(12):
        doc_id, kin = r.randrange(5, 25), text(r)
        rows += [(doc_id, varied(r, kin, 1)), (r.randrange(5, 25), varied(r, kin, 2)), (doc_id, r.choice(["", None, kin]))]
    rows += [(None, base), (None, other), (0, base)]
    expected = brute(rows)
    r.shuffle(rows)
    found = m.near_duplicates(make_docs(rows, clashing=True)).collect()
    assert len(found) == len(rows)
    assert {row.doc_id: row.component_id for row in found if row.doc_id is not None} == expected
    assert all(row.component_id == expected.get(row.doc_id) and row.kept == (row.doc_id == row.component_id) for row in found)


def test_blocks_of_one_component_do_not_meet(spark):
    """A large component and two strays: its blocks meet those of the strays only."""
    r = random.Random(11)
    words = text(r, 200)
    docs = [(i, varied(r, words, 1)) for i in range(40)] + [(100, varied(r, words, 2)), (101, text(r, 60))]
    sets = spark.createDataFrame([(i, [i] * m.BANDS, t) for i, t in docs], "node long, bands array<long>, text string")
    # One bucket for all in the first band.
    sets = sets.withColumn("bands", F.transform("bands", lambda b, i: F.when(i == 0, F.lit(7)).otherwise(b * 100 + i)))
    buckets = sets.select(F.lit(7).cast("long").alias("key"), "node")
    component = spark.createDataFrame([(i, 0) for i in range(40)], "member long, component long")
    links = {(row.u, row.v) for row in m.links_across(buckets, component, sets, 10).collect()}
    assert links and all(100 in link for link in links)
