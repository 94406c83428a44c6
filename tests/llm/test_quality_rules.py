import pytest

from emberline.llm import quality_rules as q

GOOD = "This is a sentence of eight plain words. And here is another one of some length."


def test_base_counts_match_a_plain_count():
    words = [b"a", b"b", b"c", b"d", b"e"]
    assert q.repeated_words(words * 2) == 10
    assert q.repeated_words(words + [b"x"] + words) == 10
    assert q.repeated_words([b"w"] * 6) == 6
    assert q.repeated_words(words[:4]) == 0


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words_against_tuples(seed):
    import random
    from collections import Counter

    r = random.Random(seed)
    words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(0, 60))]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    expected = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    assert q.repeated_words(words) == len(expected)


def test_wide_vocabulary_takes_the_other_way():
    words = [str(i).encode() for i in range(8000)]
    assert q.repeated_words(words + words[100:107]) == 14


@pytest.mark.parametrize(
    "line, rule",
    [
        (GOOD, None),
        ("", None),
        ("Home | News | Sport | About", "navigation"),
        ("Contact us", "navigation"),
        ("All rights reserved by the people who wrote this.", "boilerplate"),
        ("one*** two### three$$$ four&&& five!", "boilerplate"),
        ("BUY NOW WHILE IT LASTS TODAY!", "boilerplate"),
        ("five words without an end", "punctuation"),
        (")", "navigation"),
    ],
)
def test_rules_of_a_line(line, rule):
    assert q.failed_rule(line, q.words_of(line)) == rule


def test_verdicts_and_cleaned_text(spark, make_docs):
    texts = [f"{GOOD}\nHome | News\nThen comes a third one that says something else and ends.", "Home | News\n" * 20, "", None, "  \n "]
    docs = make_docs(texts, clashing=True)
    report = {row.doc_id: row for row in q.quality_report(docs).collect()}
    assert [report[i].kept for i in range(5)] == [True, False, False, False, False]
    assert report[0].n_lines_removed == 1 and report[1].n_dup_lines == 19 and report[3].n_words == 0
    cleaned = q.clean_documents(docs, n_chars="n_chars").collect()
    assert len(cleaned) == 1 and "Home" not in cleaned[0].text and cleaned[0].n_chars == len(cleaned[0].text)
    assert q.clean_documents(docs).columns == docs.columns


def test_empty_table(make_docs):
    assert q.quality_report(make_docs([])).count() == 0
    assert q.clean_documents(make_docs([])).count() == 0
