from collections import defaultdict

import pytest

from emberline.llm import mixing as x


def fill(sizes, weights=x.WEIGHTS, share=x.SHARE, cap=x.CAP):
    """Targets by handing out the excess again and again."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(w[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / open_weight for s in sizes}
        above = {s for s in sizes if target[s] > cap * sizes[s]} - full
        if not above:
            return target
        full |= above


def words(n):
    return " ".join(["w"] * n)


def test_targets_and_totals(spark, make_docs):
    import random

    r = random.Random(3)
    sizes = {"a": 60, "b": 900, "c": 300, "d": 20, "é": 500, None: 200}
    rows, doc_id = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc_id, words(r.randrange(0, 30)), source))
            doc_id += 1
    got = x.mix(make_docs(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for row in got:
        per[row.source].append(row)
        assert row.taken <= 2 * row.size and row.taken == row.copies * row.size
    held = {s: sum(row.size for row in per[s]) for s in sizes}
    expected = fill({s: held[s] for s in ["a", "b", "c", "d", "é", None]})
    for source, some in per.items():
        assert some[0].source_size == held[source]
        assert some[0].target == pytest.approx(expected[source])
        assert abs(sum(row.taken for row in some) - some[0].target) <= 15


def test_reruns_agree_and_ranges_do_not_matter(spark, make_docs):
    rows = [(i, words(1 + i % 7), "ab"[i % 2]) for i in range(200)]
    runs = [sorted(map(tuple, x.mix(make_docs(rows), ranges=n).collect())) for n in (16_384, 16_384, 1, 5)]
    assert runs[0] == runs[1] == runs[2] == runs[3]


def test_weights_of_documents_make_unequal_chances(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(i, words(10), "a") for i in range(400)])
    got = {row.doc_id: row.copies for row in x.mix(docs, share=0.5, weight=F.when(F.col("doc_id") < 200, 3.0).otherwise(1.0)).collect()}
    liked, others = sum(got[i] for i in range(200)), sum(got[i] for i in range(200, 400))
    assert liked + others == 200 and 2 < liked / others < 4.5


def test_empty_texts_repeated_rows_and_copies(spark, make_docs):
    rows = [(1, words(4), "a"), (1, words(4), "a"), (None, None, None), (2, "", "b"), (3, words(9), "b"), (3, "other " + words(8), "b")]
    docs = make_docs(rows, clashing=True)
    mixed = x.mix(docs)
    assert mixed.count() == 6
    out = x.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(row.copies for row in mixed.collect())
    assert x.mix(make_docs([])).count() == 0 and x.mixed_documents(make_docs([])).count() == 0
