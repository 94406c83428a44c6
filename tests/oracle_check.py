"""Runs registered queries beside their SQL and compares schema, row count and values.

Usage: python tests/oracle_check.py [sf folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    return value


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences between a query and its oracle, as readable lines; none means equal."""
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = [tuple(_plain(v) for v in r) for r in df.select(*columns).collect()]
    con.execute(entry.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in con.description}
    expected_rows = con.fetchall()
    if sorted(described) != columns:
        return [f"columns differ: {columns} against {sorted(described)}"]
    order = [list(described).index(c) for c in columns]
    expected = [tuple(_plain(r[i]) for i in order) for r in expected_rows]
    problems = []
    for column, kind in df.dtypes:
        wanted = TYPES.get(kind)
        if wanted and wanted != described[column]:
            problems.append(f"type of {column}: {kind} against {described[column]}")
    if len(result) != len(expected):
        problems.append(f"{len(result)} rows against {len(expected)}")
    result.sort(key=_key)
    expected.sort(key=_key)
    unequal = [(a, b) for a, b in zip(result, expected) if a != b]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first:")
        problems += [f"  {c}: {a!r} / {b!r}" for c, a, b in zip(columns, *unequal[0]) if a != b]
    return problems


def main() -> int:
    from emberline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle-check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = sys.argv[2:] or [name for name in entry.queries() if name in entry.oracle_sql()]
    failed = 0
    for name in names:
        started = time.monotonic()
        try:
            problems = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.monotonic() - started:.1f}s", flush=True)
        for line in problems:
            print("     ", line, flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
