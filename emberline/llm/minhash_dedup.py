"""Near duplicates: MinHash with banding, checked on full sets, and connected components.

A document is the set of its runs of ``SHINGLE`` words (A-Z lower-cased).  Of each set,
``BANDS * ROWS`` universal hash functions ``a * x + b`` give minima; sets whose minima agree
in a whole band share a bucket.  With 48 bands of 5, two sets of similarity 0.75 share none
with a probability of two in a million, more similar ones far less.

First each set is paired with the least document of each of its buckets; the pair passes if
the signatures are close and then if the full sets are.  Components are found by alternating
large-star and small-star steps.  Then only buckets that still hold several components are
looked into, and the sets in them compared across components, in blocks.  So a large group
of copies costs one pair per member, no link that could join two components is left out,
and a bucket is never expanded into its pairs.

Equal sets form a class before that, held by their least document.

Defined results: a document with fewer words than a run is the one run of all its words; one
without words (or null) has an empty set and is its own component; rows of equal id are
compared each on its own, with a number in place of the id, and are one node in the end, with
the links of all of them; rows with a null id are not linked, have a null component and are
kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.llm.common import PRESENT, arrays_to_batch, arrow_schema, ids_repeat, small_batches, stored
from emberline.llm.components import connected_components
from emberline.llm.groups import map_groups
from emberline.llm.hashing import mix, run_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
BANDS = 48
ROWS = 5
SLACK = 5.0
BLOCK = 1_000
SALTS = 16

_random = np.random.Generator(np.random.PCG64(20_240_601))
FACTORS = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
# Two sets of the wanted similarity fall below this share of equal minima once in millions.
LEAST_SHARE = PERCENT / 100 - SLACK * (PERCENT / 100 * (1 - PERCENT / 100) / (BANDS * ROWS)) ** 0.5
SIGNED = "doc_id long, digest binary, n_shingles long, bands array<long>, signature binary"


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct runs of words."""
    hashes = word_hashes((text or "").encode().lower())[0]
    if len(hashes) == 0:
        return hashes
    return np.unique(run_hashes(hashes, min(length, len(hashes))) ^ mix(np.uint64([min(length, len(hashes))])))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set; sets lie end to end in ``values``."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    hashed = np.empty_like(short)
    for i in range(BANDS * ROWS):
        np.multiply(short, FACTORS[i], out=hashed)
        hashed += SHIFTS[i]
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    keys = np.zeros((len(least), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mix(keys ^ least[:, row::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", values_at_once: int = 60_000) -> DataFrame:
    """The columns of SIGNED for every row; empty sets have no bands."""
    arrow = arrow_schema(docs, SIGNED)

    def sign(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        filled = [found for found in sets if len(found)]
        bands: list = [[]] * len(sets)
        short: list = [b""] * len(sets)
        if filled:
            starts = np.cumsum([0, *map(len, filled[:-1])])
            least = minima(np.concatenate(filled), starts)
            keys = band_keys(least).view(np.int64)
            low = (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            for row, place in enumerate(place for place, found in enumerate(sets) if len(found)):
                bands[place], short[place] = keys[row], low[row].tobytes()
        digests = [xxhash.xxh3_128_digest(found.tobytes()) for found in sets]
        return arrays_to_batch([ids, digests, [len(found) for found in sets], bands, short], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size = [], [], 0
        for batch in batches:
            for doc_id, value in zip(*batch.columns):
                ids.append(doc_id.as_py())
                sets.append(shingles(value.as_py()))
                size += len(sets[-1])
                if size >= values_at_once or len(sets) >= 2_000:
                    yield sign(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield sign(ids, sets)

    return small_batches(docs.select(F.col(id_col).cast("long"), F.col(text))).mapInArrow(run, SIGNED)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity; exact."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    places = np.searchsorted(b, a)
    common = int((b[np.minimum(places, len(b) - 1)] == a).sum()) if len(b) else 0
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``u, v``) whose signatures and then full sets are similar."""
    close = _close_signatures(pairs, sets.select("node", "signature"))
    texts = sets.select("node", "text")
    with_texts = (
        close.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        .join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        .select("u", "v", "a", "b")
    )
    schema = "u long, v long"
    arrow = arrow_schema(pairs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for u, v, a, b in zip(*(batch.column(name) for name in ("u", "v", "a", "b"))):
                if v.as_py() != last:
                    last, last_set = v.as_py(), shingles(b.as_py())
                if similar(shingles(a.as_py()), last_set):
                    links.append((u.as_py(), last))
            if links:
                yield arrays_to_batch(list(zip(*links)), arrow)

    return with_texts.mapInArrow(run, schema)


def _close_signatures(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    both = (
        pairs.join(signed.select(F.col("node").alias("u"), F.col("signature").alias("sa")), "u")
        .join(signed.select(F.col("node").alias("v"), F.col("signature").alias("sb")), "v")
        .select("u", "v", "sa", "sb")
    )
    schema = "u long, v long"
    arrow = arrow_schema(pairs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for name in ("sa", "sb"))
                yield batch.select(["u", "v"]).filter(pa.array(_share(a, b) >= LEAST_SHARE)).cast(arrow)

    return both.mapInArrow(run, schema)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of equal minima; one in 256 bytes agrees by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def links_across(buckets: DataFrame, component: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (``u, v``) between members of one bucket that ``component`` holds apart; exact.

    A bucket is dealt into blocks: members of a large component into blocks of their own, all
    others together.  Each two blocks that hold different components are one unit of work, so
    a few members beside a large component meet each of its blocks once.  A unit compares
    full sets, each pair in the first bucket that it shares only, and passes over pairs that
    its own links have joined meanwhile: it returns fewer links than it has members, and no
    pair of the bucket is left open.
    """
    held = buckets.join(component, F.col("node") == F.col("member"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum(F.when(F.col("n") < block, F.col("n"))).alias("others"))
        .where("components > 1").select("key", "others")
    )

    def of(n: Column) -> Column:
        return F.pmod(F.xxhash64("node"), F.ceil(n / block))

    own = F.when(F.col("n") < block, of(F.col("others"))).otherwise(F.xxhash64("component", of(F.col("n"))))
    dealt = stored(
        held.join(mixed, "key").join(sizes, ["key", "component"]).select("key", "node", "component", own.alias("own")), "minhash-blocks"
    )
    blocks = dealt.groupBy("key", "own").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    left = blocks.select("key", F.col("own").alias("one"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    right = blocks.select("key", F.col("own").alias("two"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    units = left.join(right, "key").where("one <= two AND least(a1, a2) < greatest(b1, b2)").select("key", "one", "two")
    rows = (
        units.withColumn("own", F.explode(F.array_distinct(F.array("one", "two"))))
        .join(dealt, ["key", "own"])
        .select("key", "one", "two", "own", "node", "component")
        .join(sets.select("node", "bands", "text"), "node")
    )
    schema = "u long, v long"
    arrow = arrow_schema(buckets, schema)
    keys = ["key", "one", "two"]

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        columns = {name: rows.column(name).to_numpy() for name in (*keys, "own", "node", "component")}
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, BANDS)
        texts = rows.column("text")
        change = np.any([columns[key][1:] != columns[key][:-1] for key in keys], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), rows.num_rows]
        links: list[tuple[int, int]] = []
        known: dict[int, np.ndarray] = {}
        for lo, hi in zip(edges, edges[1:]):
            one, two, own = columns["one"][lo], columns["two"][lo], columns["own"][lo:hi]
            unit_sets = []
            for place in range(lo, hi):
                node = int(columns["node"][place])
                if node not in known:
                    known[node] = shingles(texts[place].as_py())
                unit_sets.append(known[node])
            for a, b in unit_links(unit_sets, bands[lo:hi], columns["key"][lo], columns["component"][lo:hi], own == one, own == two):
                links.append((int(columns["node"][lo + a]), int(columns["node"][lo + b])))
        return arrays_to_batch(list(zip(*links)), arrow) if links else None

    return map_groups(rows, keys, ["node"], work, schema)


def unit_links(
    sets: list[np.ndarray], bands: np.ndarray, key: int, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Links between a member of ``left`` and one of ``right`` that join different components."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    sizes = np.array([len(found) for found in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(int(ids.max()) + 1, np.int64)
    current, band = component.copy(), int(np.argmax(bands[0] == key))
    rights = np.flatnonzero(right)
    links = []
    for x in np.flatnonzero(left).tolist():
        apart = rights[(current[rights] != current[x]) & (100 * np.minimum(sizes[rights], sizes[x]) >= percent * np.maximum(sizes[rights], sizes[x]))]
        apart = apart[(bands[apart] == bands[x]).argmax(axis=1) == band]
        if not len(apart):
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        inside[own] = 1
        ends = np.cumsum(sizes[apart])
        places = np.arange(ends[-1]) + np.repeat(starts[apart] - ends + sizes[apart], sizes[apart])
        common = np.add.reduceat(inside[ids[places]], ends - sizes[apart])
        inside[own] = 0
        for y in apart[100 * common >= percent * (sizes[x] + sizes[apart] - common)].tolist():
            a, b = find(int(component[x])), find(int(component[y]))
            if a != b:
                root[a] = b
                current[current == a] = b
                links.append((x, y))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    if not ids_repeat(rows):
        return _verdicts(components_of(rows, "id", "text"))

    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    named = numbered.where("id IS NOT NULL")
    found = components_of(named, "row", "text").select(F.col("doc_id").alias("row"), "n_shingles", F.col("component").alias("joint"))
    found = stored(named.select("row", "id").join(found, "row"), "minhash-found")
    # Rows of one id tie the components they are in.
    places = found.where("n_shingles > 0").select("joint", "id").distinct()
    ties = places.join(places.groupBy("joint").agg(F.min("id").alias("v")), "joint").select(F.col("id").alias("u"), "v")
    tied = connected_components(ties)
    whole = found.join(tied, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component")
    )
    nameless = signatures(numbered.where("id IS NULL"), "id", "text").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return _verdicts(whole.unionByName(nameless))


def _verdicts(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component`` for every row; ids other than null do not repeat."""
    signed = stored(signatures(docs, id_col, text), "minhash")
    linked = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(linked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "minhash-classes")
    # Members of a large class are dealt over several keys; one without copies is its own.
    copied = classes.where("n > 1").select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = linked.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    members = salted.join(copied, ["digest", "salt"], "left").select("doc_id", F.coalesce("least", "doc_id").alias("least"))
    holders = linked.join(classes.select("digest", F.col("least").alias("doc_id")), ["digest", "doc_id"])

    in_bands = holders.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = in_bands.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = stored(in_bands.join(shared.select("key", "first"), "key"), "minhash-buckets")
    nodes = buckets.select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    short = holders.select(F.col("doc_id").alias("node"), "signature", "bands").join(nodes, "node", "left_semi")
    sets = stored(texts.join(short, "node"), "minhash-sets")

    first = buckets.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    links = stored(verified(first, sets), "minhash-links")
    component = connected_components(links).withColumnRenamed("node", "member")
    links = links.unionByName(stored(links_across(buckets.select("key", "node"), component, sets), "minhash-links"))
    found = connected_components(links)

    # Equal sets are linked through their class.
    named = members.join(found, F.col("least") == F.col("node"), "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "least").alias("component")
    )
    rows = signed.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("id"), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, and every one without an id; the columns of ``docs``.

    Of several rows of a kept id the one with the greatest text stays.
    """
    kept = near_duplicates(docs, id_col, text).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    packed = docs.select(
        F.struct(F.lit(True).alias(PRESENT), *[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
    )
    place = F.row_number().over(W.partitionBy("id").orderBy(F.col(f"row.{text}").desc_nulls_last()))
    named = packed.join(kept, F.col("id") == F.col("kept_id"), "left_semi").withColumn("place", place).where("place = 1")
    chosen = named.select("row").unionByName(packed.where("id IS NULL").select("row"))
    return chosen.select([F.col("row").getField(name).alias(name) for name in docs.columns])
