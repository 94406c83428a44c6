"""Every stage of the pipeline against a plain version of it, each on what the one before left."""

import re
import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import quality_rules as q
from emberline.llm.common import stored
from emberline.llm.oracles import mixing_sql

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fails(line):
    """The line rules, one by one."""
    own = words(line)
    if not own:
        return False
    stripped = line.strip(" \t\n\x0b\x0c\r")
    ended = bool(re.search(r"[.!?:;…。！？][\"'”»)\]]*$", stripped))
    menu = sum(word in ("|", ">", "»", "•", "·", "/", "::") for word in own)
    capitals = sum(bool(re.search("[A-Z]", word)) and not re.search("[a-z]", word) for word in own)
    symbols = len(re.findall(r"[#*$%&|<>]", stripped))
    return (
        100 * menu > 15 * len(own) or (not ended and len(own) <= 3) or any(phrase in stripped.lower() for phrase in q.PHRASES)
        or 100 * symbols > 25 * len(own) or (len(own) > 3 and 100 * capitals > 60 * len(own))
        or (not ended and (len(own) < 8 or not re.search(r"[.!?…][ \t]", stripped)))
    )


def clean(rows):
    out = []
    for row in rows:
        own = words(row["text"])
        windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        covered = {i + j for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for j in range(5)}
        if len(own) < 10 or 100 * len(covered) > 20 * len(own):
            continue
        lines = row["text"].split("\n")
        left = [line for line in lines if not fails(line)]
        chars = sum(map(len, own))
        if 2 * (chars - sum(len(word) for line in left for word in words(line))) > chars:
            continue
        text = "\n".join(left)
        out.append(row | {"text": text, "n_chars": len(text)})
    return out


def apart(rows):
    sets = []
    for row in rows:
        own = [re.sub("[A-Z]", lambda c: c[0].lower(), word) for word in words(row["text"])]
        sets.append({tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} - {()})
    parent = {row["doc_id"]: row["doc_id"] for row in rows if row["doc_id"] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations([(row["doc_id"], s) for row, s in zip(rows, sets) if row["doc_id"] is not None and s], 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    best = {}
    for row in rows:
        if row["doc_id"] is not None and root(row["doc_id"]) == row["doc_id"]:
            best[row["doc_id"]] = max(best.get(row["doc_id"], row), row, key=lambda r: (r["text"] is not None, r["text"] or ""))
    return [row for row in rows if row["doc_id"] is None] + list(best.values())


def without_repeats(rows, width=35):
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        own = words(row["text"])
        gone = set()
        for i in range(len(own) - width + 1):
            window = tuple(own[i : i + width])
            if window in seen:
                gone |= set(range(i, i + width))
            seen.add(window)
        if gone and len(gone) == len(own):
            continue
        text = " ".join(word for i, word in enumerate(own) if i not in gone) if gone else row["text"]
        out.append(row | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def mixed(rows):
    con = duckdb.connect()
    columns = {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string()}
    con.register("documents", pa.table({name: pa.array([row[name] for row in rows], kind) for name, kind in columns.items()}))
    names = [d[0] for d in con.execute(mixing_sql()).description]
    copies = {row[names.index("doc_id")]: row[names.index("copies")] for row in con.execute(mixing_sql()).fetchall()}
    return [row for row in rows for _ in range(copies[row["doc_id"]])]


def check_packing(rows, packed):
    """Every piece of every document, in sequences without gaps, of which no two could be one."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for row in rows:
        ids = np.array([*plain.encode(row["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [(0, first), *((start, 1024) for start in range(first, len(ids), 1024))]
        expected += [(row["doc_id"], piece, start, n, zlib.crc32(ids[start : start + n].tobytes())) for piece, (start, n) in enumerate(cuts)]
    assert Counter(tuple(row[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")) for row in packed) == Counter(expected)
    filled = {}
    for row in sorted(packed, key=lambda row: row["offset"]):
        assert row["offset"] == filled.get(row["sequence_id"], 0)
        filled[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(filled.values()) <= 1024
    two_least = sorted(filled.values())[:2]
    assert len(filled) == 1 or sum(two_least) > 1024


def listed(df):
    return [row.asDict() for row in df.collect()]


def same(found, expected):
    key = lambda row: tuple((value is None, str(value)) for _, value in sorted(row.items()))
    assert sorted(map(key, found)) == sorted(map(key, expected))


def test_each_stage_equals_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = listed(docs)
    long_one = max(rows, key=lambda row: len(row["text"] or ""))
    rows += [
        {**long_one, "doc_id": None, "source": None}, {**rows[5], "doc_id": 10_001, "text": None}, {**rows[6], "doc_id": 10_002, "text": ""},
        rows[0], {**rows[1], "text": rows[2]["text"]}, {**rows[3], "doc_id": 10_003, "text": f"{rows[3]['text']} {rows[4]['text']}"},
    ]
    # A column with a name that stages use inside.
    docs = spark.createDataFrame([tuple(row[name] for name in docs.columns) for row in rows], docs.schema).selectExpr("*", "'x' AS row", "'y' AS node")
    rows = [row | {"row": "x", "node": "y"} for row in rows]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (clean, apart, without_repeats, mixed)):
        docs, rows = stored(stage(spark, docs, sf), "test"), plain(rows)
        assert rows, name
        same(listed(docs), rows)
    check_packing(rows, listed(corpus_pipeline.STAGES[-1][1](spark, docs, sf)))
