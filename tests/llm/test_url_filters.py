import numpy as np

from emberline.llm import url_filters as u

SCHEMA = "page_id long, url string, html string, host string, rule string"
ENTRIES = [("block", "a.com", "/x"), ("allow", "www.a.com", "/x/y"), ("block", "com", "/"), ("allow", "com", "/"), ("listed", "bad.org", ""), ("allow", "ü.de", "/é")]


def judged(spark, urls):
    pages = spark.createDataFrame([(i, url, "", "clash", "clash") for i, url in enumerate(urls)], SCHEMA)
    rows = u.judge_urls(pages, u.build_index(spark, iter(ENTRIES))).collect()
    return [(row.host, row.path, row.rule, row.verdict) for row in sorted(rows, key=lambda row: row.page_id)]


def test_longest_rule_wins(spark):
    assert judged(spark, ["http://www.A.com/x/yz?q", "http://b.a.com/xx", "http://a.com/", "http://xa.com/x", "https://z.net/x", "http://sub.bad.org#f"]) == [
        ("www.a.com", "/x/yz", "www.a.com/x/y", "allow"),
        ("b.a.com", "/xx", "a.com/x", "block"),
        ("a.com", "/", "com/", "block"),
        ("xa.com", "/x", "com/", "block"),
        ("z.net", "/x", None, "allow"),
        ("sub.bad.org", "", None, "block"),
    ]


def test_odd_urls(spark):
    assert judged(spark, [None, "", "no scheme/x", "http://ü.de/é#a", "http://com?x://y", "a://b.c/d?e://f", "http://www.a.com"]) == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("ü.de", "/é", "ü.de/é", "allow"),
        ("com", "", None, "allow"),
        ("b.c", "/d", None, "allow"),
        ("www.a.com", "", None, "allow"),
    ]


def test_empty_table_and_empty_index(spark):
    assert judged(spark, []) == []
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert u.judge_urls(pages, u.build_index(spark, [])).first().verdict == "allow"


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(u.xxhash, "xxh64_intdigest", lambda text: 7)
    path = str(tmp_path / "shard")
    u.write_shard([("block", "a.com", "/"), ("allow", "b.com", "/")], path)
    shard = u.Shard(path)
    assert [u.KINDS[shard.kinds[p]] if p >= 0 else None for p in shard.find(["b.com/", "c.com/", "a.com/"])] == ["allow", None, "block"]


def test_several_files_act_as_one(spark, monkeypatch):
    monkeypatch.setattr(u, "SHARD_ENTRIES", 2)
    assert judged(spark, ["http://www.a.com/x/y", "http://bad.org/"])[0][2] == "www.a.com/x/y"


def test_keys_are_sorted(tmp_path):
    path = str(tmp_path / "shard")
    u.write_shard([("block", f"h{i}.com", "/") for i in range(100)], path)
    shard = u.Shard(path)
    assert (np.diff(shard.keys.astype(object)) > 0).all() and len(shard.keys) == 100


def test_a_million_entries_are_mapped_without_reading_them(spark, tmp_path):
    import time

    path = str(tmp_path / "shard")
    entries = [("block", f"h{i % 1000}.site{i}.org", "/a/" if i % 7 else "") for i in range(1_000_000)]
    u.write_shard(entries, path)
    started = time.monotonic()
    shard = u.Shard(path)
    assert time.monotonic() - started < 0.5
    assert shard.labels == [3] and shard.path_chars == [0, 3] and len(shard.keys) == 1_000_000
    rules, verdicts = u.best_entries([shard], ["h5.site5.org", "x.h7.site7.org", "site7.org"], ["/a/b", "/", "/"])
    assert (rules, verdicts) == (["h5.site5.org/a/", "h7.site7.org", None], ["block", "block", "allow"])


def test_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x"), (1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id long, url string")
    rows = u.judge_urls(pages, u.build_index(spark, ENTRIES)).collect()
    assert sorted((str(row.page_id), str(row.rule)) for row in rows) == [("1", "a.com/x"), ("1", "a.com/x"), ("None", "None"), ("None", "a.com/x")]
