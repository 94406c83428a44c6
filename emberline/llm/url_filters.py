"""URL filters: rules and block lists held as a sorted array of 64-bit digests.

An entry is a host and the start of a path, written together (``example.com/en/``).  The
array of their xxhash keys is sorted, written to a file that Spark hands to every executor,
and mapped into memory there, so all workers of a machine share its pages.  A url is looked
up under each of its parent domains and each path length that some entry has; a batch of
urls is one vectorised binary search.  A key that is found is confirmed against the stored
text, so colliding keys cannot give a wrong answer.

Entries beyond ``SHARD_ENTRIES`` go to further files, each probed alike: none is dropped.

Defined results: a null url or one without ``://`` has an empty host and path and no rule;
of several rules that fit the longest text wins, then the longer host; of equal entries the
first counts; repeated rows are judged each; other columns of the table are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, arrays_to_batch

SHARD_ENTRIES = 20_000_000
KINDS = ("allow", "block", "listed")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def build_index(spark: SparkSession, entries: Iterable[tuple[str, str, str]]) -> list[str]:
    """Hand out files with the entries ``(kind, host, path)``; returns their names.

    ``entries`` is read once and in pieces; a generator over a large list is fine.
    """
    rest, names = iter(entries), []
    while not names or (shard := list(islice(rest, SHARD_ENTRIES))):
        shard = list(islice(rest, SHARD_ENTRIES)) if not names else shard
        name = f"url-filter-{uuid.uuid4().hex}.bin"
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="url-filter-")), name)
        write_shard(shard, path)
        spark.sparkContext.addFile(path)
        names.append(name)
    return names


def write_shard(entries: list[tuple[str, str, str]], path: str) -> None:
    """Layout: how many entries, label counts and path lengths there are; the label counts and path
    lengths that occur; keys in order, ends of the texts, host lengths, kinds, texts."""
    first = {host + start: (kind, host) for kind, host, start in reversed(entries)}
    texts = sorted(first, key=lambda text: (xxhash.xxh64_intdigest(text), text))
    encoded = [text.encode() for text in texts]
    labels = sorted({host.count(".") + 1 for _, host in first.values()})
    paths = sorted({len(text) - len(host) for text, (_, host) in first.items()})
    with open(path, "wb") as out:
        np.array([len(texts), len(labels), len(paths), *labels, *paths], np.uint64).tofile(out)
        np.array([xxhash.xxh64_intdigest(text) for text in texts], np.uint64).tofile(out)
        np.cumsum([0, *map(len, encoded)], dtype=np.uint64).tofile(out)
        np.array([len(first[text][1]) for text in texts], np.uint32).tofile(out)
        np.array([KINDS.index(first[text][0]) for text in texts], np.uint8).tofile(out)
        out.write(b"".join(encoded))


class Shard:
    """A mapped file of entries."""

    def __init__(self, path: str):
        n, n_labels, n_paths = np.fromfile(path, np.uint64, 3).tolist()
        known = np.fromfile(path, np.uint64, n_labels + n_paths, offset=24).tolist()
        self.labels, self.path_chars = known[:n_labels], known[n_labels:]
        parts, at = [], 8 * (3 + n_labels + n_paths)
        for kind, count in ((np.uint64, n), (np.uint64, n + 1), (np.uint32, n), (np.uint8, n)):
            parts.append(np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind))
            at += count * np.dtype(kind).itemsize
        self.keys, self.ends, self.host_chars, self.kinds = parts
        self.texts = np.memmap(path, np.uint8, "r", at) if n else np.zeros(0, np.uint8)

    def text(self, place: int) -> str:
        return self.texts[int(self.ends[place]) : int(self.ends[place + 1])].tobytes().decode()

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """Every text under which an entry that fits could be stored."""
        labels = host.split(".")
        for count in self.labels:
            if count <= len(labels):
                parent = ".".join(labels[len(labels) - count :])
                for chars in self.path_chars:
                    if chars <= len(path):
                        yield parent + path[:chars]

    def find(self, texts: list[str]) -> np.ndarray:
        """The place of each text, or -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        places = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1, np.int64)
        close = np.flatnonzero(places < len(self.keys))
        for i in close[self.keys[places[close]] == keys[close]].tolist():
            place = int(places[i])
            while place < len(self.keys) and self.keys[place] == keys[i]:
                if self.text(place) == texts[i]:
                    found[i] = place
                    break
                place += 1
        return found


_shards: dict[str, Shard] = {}


def _shard(name: str) -> Shard:
    if name not in _shards:
        _shards[name] = Shard(SparkFiles.get(name))
    return _shards[name]


def best_entries(shards: list[Shard], hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
    """For each url the best rule's text and its verdict; a listed host blocks where no rule fits."""
    best: list[tuple] = [(-1, -1, None, None)] * len(hosts)
    listed = [False] * len(hosts)
    for shard in shards:
        owners, texts = [], []
        for url, (host, path) in enumerate(zip(hosts, paths)):
            for text in shard.candidates(host, path):
                owners.append(url)
                texts.append(text)
        places = shard.find(texts)
        for i in np.flatnonzero(places >= 0).tolist():
            place, url = int(places[i]), owners[i]
            kind = KINDS[shard.kinds[place]]
            if kind == "listed":
                listed[url] = True
            else:
                best[url] = max(best[url], (len(texts[i]), int(shard.host_chars[place]), texts[i], kind), key=lambda b: b[:2])
    return [b[2] for b in best], [b[3] or ("block" if bad else "allow") for b, bad in zip(best, listed)]


def judge_urls(pages: DataFrame, index: list[str], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``; ``index`` comes from ``build_index``."""
    after = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), after.alias("rest"))
    parts = parts.withColumn("authority", F.regexp_extract("rest", "^[^/?#]*", 0))
    parts = parts.select(
        "page_id",
        F.translate("authority", UPPER, LOWER).alias("host"),
        F.regexp_extract(F.expr("substring(rest, length(authority) + 1)"), "^[^?#]*", 0).alias("path"),
    )
    arrow = arrow_schema(pages, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [_shard(name) for name in index]
        for batch in batches:
            ids, hosts, paths = (column.to_pylist() for column in batch.columns)
            yield arrays_to_batch([ids, hosts, paths, *best_entries(shards, hosts, paths)], arrow)

    return parts.mapInArrow(run, SCHEMA)
