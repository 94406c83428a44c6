import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import cross_polytope as c

SCHEMA = "vec_id long, embedding array<float>, label int, node string, vector string, values string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "n", "v", "w") for i, v in rows], SCHEMA)


def found(spark, rows, every=5, **settings):
    out = {}
    for row in c.nearest(table(spark, rows), F.col("vec_id") % every == 0, **settings).collect():
        out.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    return {k: sorted(v) for k, v in out.items()}


def exact(rows, query, k=20):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    scores = sorted((-float(vectors[i] @ vectors[query]), i) for i in vectors if i != query)
    return [i for _, i in scores[:k]]


def test_hadamard_keeps_lengths_and_undoes_itself():
    rows = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(c.hadamard(c.hadamard(rows)), rows)
    assert np.allclose((c.rotated(rows, 1, 0) ** 2).sum(1), (rows**2).sum(1))


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, unit):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(600, 24)) + 2 * r.normal(size=(8, 24))[r.integers(0, 8, 600)]
    if unit:
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(vectors)]
    got = found(spark, rows, every=20, block=50)
    hits = 0
    for query, entries in got.items():
        assert [rank for rank, _, _ in entries] == list(range(1, 21))
        for _, vec, score in entries:
            assert score == pytest.approx(float(rows[vec][1].astype(float) @ rows[query][1].astype(float)), abs=1e-12)
        hits += len({vec for _, vec, _ in entries} & set(exact(rows, query)))
    assert len(got) == 30 and hits >= 0.9 * 20 * 30


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [1, 0]), (5, None), (10, [0, 0]), (15, [float("nan"), 1]), (1, [float("inf"), 1]), (2, [None, 1]), (3, []), (4, [0.5, 0.5]), (6, [1, 1, 1])]
    assert {k: [v for _, v, _ in e] for k, e in found(spark, rows).items()} == {0: [4]}


def test_equal_vectors_ties_and_few_candidates(spark):
    rows = [(i, [1, 0]) for i in range(60)] + [(100 + i, [0, 1]) for i in range(3)] + [(7, [1, 0])]
    got = found(spark, rows)
    assert [v for _, v, _ in got[0]] == list(range(1, 21))
    assert [v for _, v, _ in got[10]] == [i for i in range(22) if i != 10][:20]
    assert [v for _, v, _ in got[100]][:2] == [101, 102]
    small = found(spark, [(0, [1, 0]), (1, [-1, 0]), (2, [0, 1])])
    assert [v for _, v, _ in small[0]] == [2, 1]


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_several_functions_make_finer_buckets():
    rows = np.random.default_rng(2).normal(size=(50, 8))
    one, two = c.buckets_of(rows, 0, 1, 1), c.buckets_of(rows, 0, 1, 2)
    assert one.max() < 16 and (two // 16 == one).all() and len(np.unique(two)) > len(np.unique(one))
    assert (c.buckets_of(rows, 0, 5, 2)[:, :1] == two).all()


def embeddings(n, d, seed):
    """Unit vectors around a few hundred centres."""
    r = np.random.default_rng(seed)
    vectors = r.normal(size=(n, d)) + 1.5 * r.normal(size=(n // 10, d))[r.integers(0, n // 10, n)]
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def lengthened(vectors, how):
    r = np.random.default_rng(5)
    factors = np.ones(len(vectors))
    if how == "one":
        factors[3] = 2
    if how == "mixed":
        factors = r.lognormal(0, 0.5, len(vectors))
    return vectors * factors[:, None]


@pytest.mark.parametrize("d, how", [(64, "one"), (64, "mixed"), (256, "one")])
def test_recall_does_not_depend_on_lengths_and_width(spark, d, how):
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(lengthened(embeddings(2000, d, d), how))]
    got = found(spark, rows, every=50)
    hits = [len({vec for _, vec, _ in got[query]} & set(exact(rows, query))) for query in range(0, 2000, 50)]
    assert np.mean(hits) >= 0.95 * 20 and min(hits) >= 14


def test_safe_cosine_is_tried_out():
    some = [c.safe_cosine(64, tables, 16, 1, 0.95) for tables in (2, 8, 32)]
    assert 1 >= some[0] > some[1] > some[2] >= 0
    assert c.safe_cosine(64, 8, 16, 1, 1.1) > 1
