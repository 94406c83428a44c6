import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberline.llm import lpf_dedup, suffix_tree_dedup
from emberline.llm.hashing import sliding_min, word_hashes
from emberline.llm.suffixes import suffix_order


def windows(sequences, width):
    """Every window with its places: (row, start)."""
    places = {}
    for row, sequence in enumerate(sequences):
        for start in range(len(sequence) - width + 1):
            places.setdefault(sequence[start : start + width], []).append((row, start))
    return places


def removed_flags(sequences, width, keep):
    flags = [[False] * len(sequence) for sequence in sequences]
    for places in windows(sequences, width).values():
        for row, start in places[1:] if keep == "first" else (places if len(places) > 1 else []):
            flags[row][start : start + width] = [True] * width
    return flags


def corpus(seed, alphabet, joiner=""):
    r = random.Random(seed)
    piece = lambda n: [r.choice(alphabet) for _ in range(n)]
    shared = [piece(r.randrange(5, 60)) for _ in range(4)]
    texts = []
    for _ in range(25):
        parts = [r.choice(shared) if r.random() < 0.4 else piece(r.randrange(0, 40)) for _ in range(r.randrange(0, 5))]
        texts.append(joiner.join(x for part in parts for x in part))
    texts += [texts[3], texts[3], "", alphabet[0] * 70 if not joiner else joiner.join(alphabet[:2] * 30)]
    return texts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("seed, group_items", [(0, 10**6), (1, 10**6), (2, 40)])
def test_strings_against_all_windows(spark, make_docs, seed, group_items, keep):
    texts = corpus(seed, "abcé")
    data = [text.encode() for text in texts]
    items = lpf_dedup.byte_items(width=12, gram=4, group_items=group_items)
    got = {row.doc_id: row for row in lpf_dedup.repeated_strings(make_docs(texts, clashing=True), keep=keep, items=items).collect()}
    for i, flags in enumerate(removed_flags(data, 12, keep)):
        left = bytes(b for b, gone in zip(data[i], flags) if not gone)
        spans = sum(gone and (j == 0 or not flags[j - 1]) for j, gone in enumerate(flags))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data[i]), sum(flags), spans, hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("seed, group_items", [(0, 10**6), (1, 10**6), (2, 20)])
def test_passages_against_all_windows(spark, make_docs, seed, group_items, keep):
    texts = corpus(seed, ["a", "b", "É", "dd"], joiner=" ")
    words = [tuple(text.split()) for text in texts]
    items = suffix_tree_dedup.word_items(width=6, gram=3, group_items=group_items)
    got = {row.doc_id: row for row in suffix_tree_dedup.repeated_passages(make_docs(texts), keep=keep, items=items).collect()}
    for i, flags in enumerate(removed_flags(words, 6, keep)):
        left = " ".join(w for w, gone in zip(words[i], flags) if not gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words[i]), sum(flags), hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("module, items", [(lpf_dedup, lpf_dedup.byte_items(8, 3)), (suffix_tree_dedup, suffix_tree_dedup.word_items(8, 3))])
def test_null_ids_repeated_rows_and_empty_tables(spark, make_docs, module, items):
    run = module.repeated_strings if module is lpf_dedup else module.repeated_passages
    passage = "one two three four five six seven eight nine"
    rows = [(None, passage), (None, "nothing like it in here at all, my friend, no"), (1, None), (2, "x " + passage), (2, "x " + passage), (3, "")]
    got = sorted((str(row.doc_id), row.n_removed > 0) for row in run(make_docs(rows), keep="none", items=items).collect())
    assert got == sorted([("None", True), ("None", False), ("1", False), ("2", True), ("2", True), ("3", False)])
    assert run(make_docs([]), items=items).count() == 0
    docs = make_docs([(1, passage), (2, "start of it " + passage), (3, passage), (4, None)], clashing=True)
    cleaned = module.clean_documents(docs, n_chars="n_chars", items=items)
    assert cleaned.columns == docs.columns
    left = {row.doc_id: row.text for row in cleaned.collect()}
    assert left[1] == passage and 3 not in left and passage not in left[2] and left[4] is None


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeated_and_null_ids_are_rows_of_their_own(spark, keep):
    r = random.Random(6)
    texts = corpus(6, "abcé") * 2
    ids = sorted((r.choice([None, 1, 2, 3]) for _ in texts), key=lambda i: (i is not None, i or 0))
    docs = spark.createDataFrame([(i, text, "x") for i, text in zip(ids, texts)], "doc_id long, text string, row string").coalesce(1)
    data = [text.encode() for text in texts]
    got = lpf_dedup.repeated_strings(docs, keep=keep, items=lpf_dedup.byte_items(width=12, gram=4)).collect()
    expected = [
        (str(i), hashlib.sha256(bytes(b for b, gone in zip(one, flags) if not gone)).hexdigest())
        for i, one, flags in zip(ids, data, removed_flags(data, 12, keep))
    ]
    assert sorted((str(row.doc_id), row.kept_sha256) for row in got) == sorted(expected)


def test_rows_without_an_id_are_not_gathered(spark, make_docs):
    """Segments and stretches are joined by row: no more of them than there are in a text."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"a{i} {passage} b{i}") for i in range(400)]
    found = suffix_tree_dedup.repeated_passages(make_docs(rows), keep="none").collect()
    assert {(row.n_words, row.n_removed) for row in found} == {(62, 60)}


@pytest.mark.parametrize("seed", range(20))
def test_suffix_order_and_previous_factors(seed):
    r = np.random.default_rng(seed)
    codes = r.integers(1, 3, r.integers(1, 80))
    depth = int(r.integers(1, 20))
    n = len(codes)
    cut = [tuple(codes[i : i + depth]) for i in range(n)]
    order, common = suffix_order(codes, depth)
    assert order.tolist() == sorted(range(n), key=lambda i: (cut[i], i))

    def shared(a, b):
        k = 0
        while max(a, b) + k < n and k < depth and codes[a + k] == codes[b + k]:
            k += 1
        return k

    wanted = r.random(n) < 0.7
    tied, shared_by = suffix_order(codes, depth, wanted & (np.arange(n) + depth <= n))
    full = [i for i in order.tolist() if wanted[i] and i + depth <= n]
    several = [i for i in full if sum(cut[i] == cut[j] for j in full) > 1]
    assert [i for i in tied.tolist() if i in several] == several
    for a, b, c in zip(tied.tolist(), tied.tolist()[1:], shared_by.tolist()[1:]):
        assert (c == depth) == (cut[a] == cut[b])
    factor = np.empty(n, int)
    factor[order] = lpf_dedup.longest_previous_factor(order, common)
    for i in range(n):
        longest = max((shared(i, j) for j in range(i)), default=0)
        assert (factor[i] >= depth) == (longest >= depth) and factor[i] <= longest


def test_no_suffix_is_left_to_sort():
    codes = np.tile(np.arange(1, 40), 3)
    for wanted in (np.zeros(len(codes), bool), np.arange(len(codes)) < 5):
        order, common = suffix_order(codes, 300, wanted)
        assert len(order) == len(common) == 0 or not (common >= 300).any()


def test_deep_nodes_are_the_repeats():
    codes = np.array([1, 2, 3, 9, 1, 2, 3, 8, 2, 3])
    nodes = suffix_tree_dedup.maximal_repeats(codes, 3)
    assert [places.tolist() for places in nodes] == [[0, 4]]
    assert sorted(sorted(places.tolist()) for places in suffix_tree_dedup.maximal_repeats(codes, 2)) == [[0, 4], [1, 5, 8]]


def test_word_hashes_depend_on_the_word_alone():
    data = "b a\tab  é\nba ab \x1c a".encode()
    hashes, starts, ends = word_hashes(data)
    words = [data[a:b] for a, b in zip(starts, ends)]
    assert words == data.split()
    by_word = Counter(zip(words, hashes.tolist()))
    assert len({h for _, h in by_word}) == len(set(words)) == len(by_word)


def test_sliding_min():
    values = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 50):
        assert sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(51 - width)]
