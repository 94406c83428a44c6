"""Approximate nearest neighbours by cross-polytope hashing with several probes per table.

A vector is turned by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and falls into the bucket of its nearest signed axis; each of ``TABLES`` tables
has a rotation of its own.  A query looks into the buckets of its nearest axes of each table
(``PROBES`` or an eighth of all axes, whichever is more), and everything there is ranked by
its exact inner product in double precision.
With ``functions`` over 1 a bucket is that of several rotations together, for tables whose
buckets would be too large with one.

Buckets are dealt into blocks of vectors and of queries; a pair of blocks is one unit of
work, one matrix product.  Equal vectors are one entry that knows the ids that can be
asked of it, so a vector that a third of all rows share costs what one costs.

Buckets know directions only, so what they miss is made good by length.  Vectors are parted
into bands of similar length.  With the least score a query has found, a vector of a band can
only be nearer if its cosine to the query is over that score by both lengths.  A query is
done with a band if no cosine is that large, or if buckets find a vector of that cosine with
the probability ``recall`` (tried out on random pairs for each width).  Otherwise it is
compared with the whole band, in blocks; a query that found too few is with every band.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows with a null id; vectors of another dimension than the query's are
no neighbours of it; rows of equal id and vector are one; ties go to the smaller id; with
fewer candidates than asked all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.llm.common import arrays_to_batch, arrow_schema, stored
from emberline.llm.groups import map_groups

TABLES = 8
PROBES = 16
NEIGHBOURS = 20
BLOCK = 4_096
SEED = 11
RECALL = 0.95
BANDS = 8
MADE_BYTES = 16 << 20
TRIED_PAIRS = 400


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width, step = len(rows), rows.shape[1], 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotated(rows: np.ndarray, table: int, function: int) -> np.ndarray:
    signs = np.random.Generator(np.random.PCG64([SEED, table, function])).choice([-1.0, 1.0], (3, rows.shape[1]))
    for round_signs in signs:
        rows = hadamard(rows * round_signs)
    return rows


def width_of(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def probes_of(width: int, probes: int | None) -> int:
    """``probes``, or by default a fixed share of the ``2 * width`` axes."""
    return probes or max(PROBES, width // 4)


def lengths_of(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares leave the range of doubles."""
    most = np.abs(rows).max(axis=1)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(((rows / most[:, None]) ** 2).sum(axis=1)), np.finfo(float).max)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 at a width of a power of two."""
    n, d = vectors.shape
    out = np.zeros((n, width_of(d)))
    out[:, :d] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return out / lengths_of(out)[:, None]


def buckets_of(rows: np.ndarray, table: int, probes: int, functions: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each row: numbers of signed axes, one digit per function."""
    best = np.zeros((len(rows), 1), np.int64)
    cost = np.zeros((len(rows), 1))
    for function in range(functions):
        turned = rotated(rows, table, function)
        axes = np.concatenate([turned, -turned], axis=1)
        wanted = min(probes, axes.shape[1])
        near = np.argpartition(-axes, wanted - 1, axis=1)[:, :wanted]
        away = np.take_along_axis(axes, near, 1)
        away = away.max(axis=1, keepdims=True) - away
        numbers = (best[:, :, None] * axes.shape[1] + near[:, None, :]).reshape(len(rows), -1)
        costs = (cost[:, :, None] + away[:, None, :]).reshape(len(rows), -1)
        keep = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        best, cost = np.take_along_axis(numbers, keep, 1), np.take_along_axis(costs, keep, 1)
    return best


def safe_cosine(width: int, tables: int, probes: int, functions: int, recall: float) -> float:
    """The least cosine (in steps of 0.01) at which buckets find a vector with probability ``recall``; over 1 if none."""
    pairs = np.random.Generator(np.random.PCG64([SEED, width])).normal(size=(2, TRIED_PAIRS, width))
    one = pairs[0] / np.linalg.norm(pairs[0], axis=1, keepdims=True)
    other = pairs[1] - (pairs[1] * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    looked = [buckets_of(one, table, probes, functions) for table in range(tables)]
    low, high = 0, 101
    while low < high:
        middle = (low + high) // 2
        there = one * (middle / 100) + other * np.sqrt(max(0.0, 1 - (middle / 100) ** 2))
        met = np.any([(buckets_of(there, table, 1, functions) == looked[table]).any(axis=1) for table in range(tables)], axis=0)
        if met.mean() >= recall:
            high = middle
        elif middle == 100:
            return 2.0
        else:
            low = middle + 1
    return high / 100


def _hashed(vectors: DataFrame, kind: str, query: bool, tables: int, probes: int | None, functions: int) -> DataFrame:
    """A row for each bucket that a vector (``node, vector``) belongs to or looks into."""
    schema = "node long, space int, bucket long, vector binary"
    arrow = arrow_schema(vectors, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raw = batch.column("node").to_numpy(), batch.column("vector").to_pylist()
            sizes = np.array([len(value) for value in raw])
            for size in np.unique(sizes):
                alike = np.flatnonzero(sizes == size)
                d = int(size) // np.dtype(kind).itemsize
                wanted = probes_of(width_of(d), probes) if query else 1
                # What is made at once is bounded in bytes, however wide vectors are.
                step = max(1, min(500, MADE_BYTES // (int(size) * wanted * tables)))
                for at in range(0, len(alike), step):
                    own = alike[at : at + step]
                    rows = directions(_matrix([raw[i] for i in own], kind))
                    made = [buckets_of(rows, table, wanted, functions) for table in range(tables)]
                    each = made[0].shape[1] * tables
                    spaces = np.repeat(np.arange(tables) + tables * d, made[0].shape[1])
                    yield arrays_to_batch(
                        [np.repeat(nodes[own], each), np.tile(spaces, len(own)), np.concatenate(made, axis=1).ravel(), [raw[i] for i in own for _ in range(each)]],
                        arrow,
                    )

    return vectors.select("node", "vector").mapInArrow(run, schema)


def _best_in_blocks(data: DataFrame, queries: DataFrame, kind: str, k: int, block: int) -> DataFrame:
    """For each query and unit the ``k`` best entries, as arrays of ids and scores.

    Both sides have ``node, space, bucket, vector``.  Where a bucket has more than ``block``
    vectors or queries, each pair of its blocks is a unit.
    """
    sizes = (
        data.groupBy("space", "bucket").agg(F.count("*").alias("n"))
        .join(queries.groupBy("space", "bucket").agg(F.count("*").alias("m")), ["space", "bucket"])
        .select("space", "bucket", F.ceil(F.col("n") / block).cast("int").alias("data_blocks"), F.ceil(F.col("m") / block).cast("int").alias("query_blocks"))
    )

    def dealt(side: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        placed = side.join(sizes, ["space", "bucket"]).withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"{own}s")).cast("int"))
        spread = placed.withColumn(other, F.explode(F.expr(f"sequence(0, {other}s - 1)")))
        return spread.select("space", "bucket", "data_block", "query_block", F.lit(is_query).alias("is_query"), "node", "vector")

    units = dealt(data, "data_block", "query_block", False).unionByName(dealt(queries, "query_block", "data_block", True))
    keys = ["space", "bucket", "data_block", "query_block"]
    schema = "query long, nodes array<long>, scores array<double>"
    arrow = arrow_schema(data, schema)

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        columns = [rows.column(key).to_numpy() for key in keys]
        is_query = rows.column("is_query").to_numpy()
        nodes, raw = rows.column("node").to_numpy(), rows.column("vector").to_pylist()
        change = np.any([column[1:] != column[:-1] for column in columns], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(nodes)]
        out: list[tuple] = []
        for lo, hi in zip(edges, edges[1:]):
            asked = np.flatnonzero(is_query[lo:hi]) + lo
            there = np.flatnonzero(~is_query[lo:hi]) + lo
            if len(asked) and len(there):
                matrix = _matrix([raw[i] for i in there], kind)
                for at in range(0, len(asked), 256):
                    some = asked[at : at + 256]
                    wanted = _matrix([raw[i] for i in some], kind)
                    for i, (near, scores) in enumerate(_top(wanted, matrix, nodes[there], k)):
                        out.append((int(nodes[some[i]]), near, scores))
        return arrays_to_batch(list(zip(*out)), arrow) if out else None

    return map_groups(units, keys, ["is_query", "node"], work, schema)


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _top(queries: np.ndarray, matrix: np.ndarray, nodes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and exact scores of the ``k`` best rows of ``matrix`` for each query."""
    rough = queries @ matrix.T
    least = np.full(len(queries), -np.inf) if len(nodes) <= k else -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    margin = 1e-9 * (1 + np.abs(rough).max(axis=1))
    for i in range(len(queries)):
        near = np.flatnonzero(rough[i] >= least[i] - margin[i])
        scores = (matrix[near] * queries[i]).sum(axis=1)
        order = np.lexsort((nodes[near], -scores))[:k]
        yield nodes[near[order]], scores[order]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``query, node, score``: the ``k`` best of all units of each query."""
    schema = "query long, node long, score double"
    arrow = arrow_schema(found, schema)

    def work(rows: pa.Table) -> pa.RecordBatch:
        lengths = np.array([len(value) for value in rows.column("nodes")])
        query = np.repeat(rows.column("query").to_numpy(), lengths)
        node = rows.column("nodes").combine_chunks().flatten().to_numpy()
        score = rows.column("scores").combine_chunks().flatten().to_numpy()
        order = np.lexsort((node, -score, query))
        query, node, score = query[order], node[order], score[order]
        # Equal hits of several tables are neighbours in this order: their scores are equal.
        first = np.concatenate(([True], (query[1:] != query[:-1]) | (node[1:] != node[:-1])))
        query, node, score = query[first], node[first], score[first]
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        return arrays_to_batch([query[place < k], node[place < k], score[place < k]], arrow)

    return map_groups(found, ["query"], [], work, schema)


def nearest(
    vectors: DataFrame,
    is_query: F.Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    tables: int = TABLES,
    probes: int | None = None,
    functions: int = 1,
    block: int = BLOCK,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query`` holds.

    ``recall`` is the least probability with which each true neighbour is found; over 1 all are.
    """
    sound = (
        f"`{vector}` IS NOT NULL AND `{id_col}` IS NOT NULL AND exists(`{vector}`, x -> x <> 0) "
        f"AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1.7976931348623157E308D)"
    )
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    values = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), values.alias("values"))
    # Of equal vectors only the least k + 1 ids can be among anyone's neighbours.
    place = F.row_number().over(W.partitionBy("values").orderBy("vec_id"))
    least = rows.groupBy("values", "vec_id").agg(F.max("asked").alias("asked"))
    classes = least.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("values").agg(
        F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    # A node is named by its least id and, as an id may have several vectors, the vector's hash.
    known = stored(_as_binary(classes.withColumn("node", F.xxhash64("node", "values")), kind), "vectors")
    asked = stored(
        rows.where("asked").select("vec_id", "values").distinct()
        .join(classes.select("values", F.xxhash64("node", "values").alias("node")), "values")
        .select("vec_id", "node"),
        "queries",
    )
    wanted = known.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vector", "length")
    found = _best_in_blocks(_hashed(known, kind, False, tables, 1, functions), _hashed(wanted, kind, True, tables, probes, functions), kind, k + 1, block)
    best = stored(_merged(found, k + 1), "found")
    # Ids, not vectors, have to be enough: a query has a bound if its entries hold k ids besides its own.
    bounds = (
        best.join(known.select("node", F.size("ids").alias("n")), "node").groupBy("query")
        .agg(F.sum("n").alias("n"), F.min("score").alias("bound")).where(F.col("n") > k).select(F.col("query").alias("node"), "bound")
    )
    item = np.dtype(kind).itemsize
    space = F.length("vector").alias("space")
    bands = known.groupBy(space, "band").agg(F.max("length").alias("longest"))
    sizes = [row["space"] for row in bands.select("space").distinct().collect()]
    safe = {width: safe_cosine(width, tables, probes_of(width, probes), functions, recall) for width in {width_of(size // item) for size in sizes}}
    cosines = known.sparkSession.createDataFrame([(size, safe[width_of(size // item)]) for size in sizes], "space int, safe double")
    bands = bands.join(F.broadcast(cosines), "space")
    # No cosine is over 1, but for rounding.
    reach = F.col("length") * F.col("longest") * F.least("safe", F.lit(1 + 1e-9))
    open_bands = stored(
        wanted.withColumn("space", space).join(bounds, "node", "left").join(F.broadcast(bands), "space")
        .where(F.col("bound").isNull() | ~(F.col("bound") >= reach))
        .select("node", "space", F.col("band").alias("bucket"), "vector"),
        "open-bands",
    )
    if not open_bands.isEmpty():
        whole = known.select("node", space, F.col("band").alias("bucket"), "vector")
        rest = _best_in_blocks(whole, open_bands, kind, k + 1, block)
        best = stored(_merged(best.select("query", F.array("node").alias("nodes"), F.array("score").alias("scores")).unionByName(rest), k + 1), "best")

    # Everything below works on at most k + 1 entries a query and k + 1 ids an entry.
    hits = (
        best.join(known.select("node", "ids"), "node")
        .select("query", F.explode("ids").alias("vec_id"), "score")
        .join(asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")), "query")
        .where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _as_binary(classes: DataFrame, kind: str) -> DataFrame:
    """``node, ids, vector, length, band``: components as little-endian numbers of their own width."""
    schema = "node long, ids array<long>, vector binary, length double, band long"
    arrow = arrow_schema(classes, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.asarray(value.values, "<f8") for value in batch.column("values")]
            raw = [v.astype(kind).tobytes() for v in values]
            lengths = np.array([lengths_of(v[None])[0] for v in values])
            bands = np.floor(np.log2(lengths) * BANDS).astype(np.int64)
            yield arrays_to_batch([batch.column("node"), batch.column("ids"), raw, lengths, bands], arrow)

    return classes.select("node", "ids", "values").mapInArrow(run, schema)
