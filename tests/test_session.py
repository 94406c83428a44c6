"""Scratch tables and their end."""

import os

from emberline import session


def test_scratch_tables_are_removed_on_demand(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    paths = [session.scratch_dir(spark, label) for label in ("one", "two", "never-written")]
    for path in paths[:2]:
        spark.range(3).write.parquet(path)
    assert session.remove_scratch(spark) == 2
    assert not any(os.path.exists(path) for path in paths)
    assert session.remove_scratch(spark) == 0


def test_the_package_is_shipped_once(spark):
    session.ship_package(spark)
    first = list(spark.sparkContext._python_includes)
    session.ship_package(spark)
    assert spark.sparkContext._python_includes == first and any("emberline" in name for name in first)
