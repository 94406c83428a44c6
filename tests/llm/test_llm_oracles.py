import os

import pytest
from oracle_check import compare, connect

from emberline.llm import oracles, queries

# Queries that SQL does not express, or not on whole tables, with the tests that stand in for it.
STAND_INS = {
    "op3_lpf_dedup": "test_repeats.py::test_strings_against_all_windows",
    "op4_compression_classifier": "test_compression_classifier.py::test_held_out_accuracy",
    "op9_packing": "test_packing.py::test_ids_are_those_of_the_tokenizer",
    "op10_cross_polytope": "test_cross_polytope.py::test_recall_and_exact_scores",
    "pipeline": "test_pipeline_content.py::test_each_stage_equals_a_plain_version",
}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql_or_a_test_that_stands_in():
    assert sorted([*oracles.build(), *STAND_INS]) == sorted([*queries.QUERIES, "pipeline"])
    for place in STAND_INS.values():
        file, name = place.split("::")
        with open(os.path.join(os.path.dirname(__file__), file)) as text:
            assert f"def {name}(" in text.read()


@pytest.mark.parametrize("name", sorted(oracles.build()))
def test_equal_to_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf) == []
