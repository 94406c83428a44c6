import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from emberline.llm import packing as p  # noqa: E402

RANKS = "byte_bpe_50k.tiktoken"


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = p.tokenizer(RANKS, public_tokenizers.PATTERN)
    r = random.Random(1)
    texts = ["", " ", "a  b", " a", "a ", "a\n b", "it's I'll don't 's", "x <|endoftext|> y", "日本 語\u3000 テ", "a\x1cb c", "\x85 a", "12 34a"]
    texts += ["".join(r.choice(" aé1'.\n\tsS l語\x1c\u00a0") for _ in range(r.randrange(1, 14))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n, pieces", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cuts(n, pieces):
    assert p.cut(n, 8) == pieces


def valid(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(20))
def test_search_never_loses_a_piece_and_never_needs_more(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 60) for _ in range(r.randrange(1, 200))]
    before = p.best_fit(lengths, 100)
    after = p.local_search([list(b) for b in before], lengths, 100)
    valid(before, lengths, 100)
    valid(after, lengths, 100)
    assert len(after) <= len(before)


def test_search_mends_what_best_fit_leaves():
    # Three sequences hold these; a bad start of four comes down to three.
    lengths = [6, 4, 5, 5, 3, 3, 4]
    start = [[0, 4], [2, 6], [1, 5], [3]]
    assert len(p.local_search(start, lengths, 10)) == 3


@pytest.mark.parametrize("n", [39, 40, 60, 3000])
def test_search_looks_beyond_the_fullest_sequences(n):
    # Sequences of one shape that can take part in nothing come first in order of fill.
    lengths = [702] * n + [320] * n + [512, 400, 324, 300, 300, 212]
    bins = p.pack_lengths(lengths, 1024)
    valid(bins, lengths, 1024)
    assert len(bins) == n + 2


@pytest.mark.parametrize("seed", range(10))
def test_search_ends_only_when_nothing_gains(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 40) for _ in range(60)]
    sizes = [[lengths[i] for i in b] for b in p.local_search([[i] for i in range(60)], lengths, 100)]
    for a, low in enumerate(sizes):
        pairs = [low[i] + low[j] for i in range(len(low)) for j in range(i)]
        for b, high in enumerate(sizes):
            if a != b and sum(low) <= sum(high):
                room = 100 - sum(high)
                assert not any(back < size <= room + back for back in (0, *high) for size in (*low, *pairs))


def test_pieces_fill_sequences_without_gaps(spark, make_docs):
    r = random.Random(2)
    texts = [" ".join("word%d" % r.randrange(99) for _ in range(r.choice([0, 3, 50, 900, 3000]))) for _ in range(60)] + [None, "same", "same"]
    docs = make_docs([*enumerate(texts), (0, texts[0]), (None, "no id")], clashing=True)
    rows = p.pack(p.token_pieces(docs, RANKS, public_tokenizers.PATTERN), group_pieces=15).collect()
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append(row)
    for some in sequences.values():
        at = 0
        for row in sorted(some, key=lambda row: row.offset):
            assert row.offset == at
            at += row.length
        assert at <= 1024
    own = p.tokenizer(RANKS, public_tokenizers.PATTERN)
    for i, text in enumerate(texts):
        ids = own.ids(text or "") + (2).to_bytes(4, "little")
        mine = {row.piece: row for row in rows if row.doc_id == i}
        assert sum(row.length for row in mine.values()) * 4 == len(ids)
        for row in mine.values():
            assert row.ids_crc32 == zlib.crc32(ids[4 * row.start : 4 * (row.start + row.length)])
    assert sum(row.doc_id is None for row in rows) == 1
    total = sum(row.length for row in rows)
    assert len(sequences) <= total / 1024 * 1.1 + 5


def test_equal_rows_are_dealt_to_all_groups(spark):
    pieces = spark.range(400).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "7L AS ids_crc32")
    rows = p.pack(pieces, capacity=8, group_pieces=40).collect()
    sizes = {}
    for row in rows:
        sizes[row.sequence_id >> 32] = sizes.get(row.sequence_id >> 32, 0) + 1
    assert len(rows) == 400 and len(sizes) == 10 and max(sizes.values()) < 100


def test_ids_on_demand_and_empty_table(spark, make_docs):
    row = p.token_pieces(make_docs([(1, "a b")]), RANKS, public_tokenizers.PATTERN, with_ids=True).first()
    assert zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32 and row.ids[-1] == 2
    assert p.packed_documents(make_docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
