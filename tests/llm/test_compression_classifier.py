import numpy as np
import pytest

from emberline.llm import compression_classifier as cc

GOOD = ["the river runs past quiet fields and the old mill turns slowly in the evening light %d" % i for i in range(300)]
BAD = ["BUY cheap $$$ pills!!! click click click %d ### WIN ### now &&& free" % i for i in range(300)]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(GOOD + BAD)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(5, None), (None, 1), (7, 3)], "doc_id long, label int")
    return docs, labels


def test_parts_the_classes(labelled, spark):
    docs, labels = labelled
    model = cc.fit(docs, labels.where("doc_id % 3 <> 0"))
    scored = cc.score(docs.where("doc_id % 3 = 0"), model).collect()
    right = sum((row.doc_id < 300) == (row.score >= 0.5) for row in scored)
    assert right >= 0.95 * len(scored)
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.3) for row in scored)


def test_empty_and_null_texts_have_one_score(labelled, spark):
    docs, labels = labelled
    model = cc.fit(docs, labels)
    rows = cc.score(spark.createDataFrame([(1, ""), (2, None), (2, None)], "doc_id long, text string"), model).collect()
    assert len(rows) == 3 and len({row.score for row in rows}) == 1


def test_missing_class_and_no_labels(labelled, spark):
    docs, labels = labelled
    assert cc.fit(docs, labels.where("label = 1 AND doc_id < 9")).score("anything") > 0.8
    assert cc.fit(docs, labels.where("false")).score("anything") == pytest.approx(0.5)


def test_curve_follows_the_labels():
    x = np.concatenate([np.linspace(-1, 0.2, 200), np.linspace(-0.2, 1, 200)])
    slope, intercept = cc.fit_curve(x, np.repeat([0, 1], 200))
    assert slope > 0 and abs(intercept) < 0.2


def test_scores_keep_the_share_of_unequal_classes(spark):
    # Words of both kinds in every text, so that the classes overlap.
    r = np.random.default_rng(3)
    kinds = (r.random(1500) < 0.86).astype(int)
    texts = [" ".join("%s%d" % ("good" if r.random() < 0.45 + 0.1 * kind else "bad", r.integers(40)) for _ in range(60)) for kind in kinds]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(kinds.tolist())), "doc_id long, label int")
    model = cc.fit(docs, labels, per_class=60, calibration=60)
    assert np.mean([model.score(text) for text in texts]) == pytest.approx(kinds.mean(), abs=0.06)


def test_dictionaries_learn_whole_texts(spark, monkeypatch):
    texts = [t * 90 for t in GOOD[:20] + BAD[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, label int")
    seen = []
    build = cc.build_dictionary
    monkeypatch.setattr(cc, "build_dictionary", lambda samples: seen.append(samples) or build(samples))
    cc.fit(docs, labels, per_class=5, calibration=5)
    assert [len(samples) for samples in seen] == [5, 5] and {t.decode() for samples in seen for t in samples} <= set(texts)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(i, t) for i, t in enumerate(GOOD[:40] + BAD[:40])] + [(None, "a"), (None, None), (3, "another text of it"), (90, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS label", "'y' AS score", "0 AS feature", "1 AS tie", "2 AS picked_id")
    labels = spark.createDataFrame([(i, int(i < 40), "z") for i in range(80)] + [(4, 0, "z"), (90, 1, "z")], "doc_id long, label int, text string")
    model = cc.fit(docs, labels)
    scored = cc.score(docs, model).collect()
    assert sorted(str(row.doc_id) for row in scored) == sorted(str(doc_id) for doc_id, _ in rows)
    assert len({row.score for row in scored if row.doc_id == 90} | {model.score(None)}) == 1
    # An id with both labels teaches nothing.
    assert {row.doc_id for row in cc.clean_labels(labels, "doc_id", "label").collect()} == {*range(80), 90} - {4}
    empty = docs.where("false")
    assert cc.score(empty, cc.fit(empty, labels)).count() == 0


def test_curve_is_fitted_on_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t * 90) for i, t in enumerate(GOOD[:60] + BAD[:60])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, label int")
    seen = []
    curve = cc.fit_curve
    monkeypatch.setattr(cc, "fit_curve", lambda features, kinds: seen.append(features) or curve(features, kinds))
    model = cc.fit(docs, labels, per_class=30, calibration=30)
    whole = {model.feature(t * 90) for t in GOOD[:60] + BAD[:60]}
    assert len(seen[0]) == 60 and set(seen[0]) <= whole


def test_held_out_accuracy(spark, sf):
    from emberline.llm.queries import QUERIES

    folder = sf.replace("0.001", "0.01")
    scored = QUERIES["op4_compression_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL")
    held = scored.where("held_out").join(labels, "doc_id").collect()
    good = [row.score for row in held if row.quality == 1]
    bad = [row.score for row in held if row.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc >= 0.9
