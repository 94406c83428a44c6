"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its share by weight, at most ``cap`` times what
it has, what is above going to the others by weight.  A document's expected number of
copies is its source's target over the source's size (times its own weight, if one is
given).  The whole part of that is certain.  The rest is an inclusion probability p: the
documents of a source are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with a uniform u made
from the id, and are taken in that order until the source's words are nearest its target.

No source is ever sorted as a whole: words are summed by ranges of the rank, the range in
which the target falls is found from the sums, and only its documents are put in order.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of
its own and comes last; rows of equal id and size are interchangeable; an empty table gives
an empty mix; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.llm.common import PRESENT, n_words, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
RANGES = 16_384
HEX_DIGITS = 13


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def source_targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Filling all sources at a common level per weight, a source is full at the level
    ``cap * size / weight``.  In the order of those levels, the sources whose level needs no
    more words than there are get their cap; the rest share what is left by weight.
    """
    listed = F.array(*[F.lit(float(weight)) for weight in weights])
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    everything = W.partitionBy()
    levels = (
        totals.withColumn("weight", F.element_at(listed, ((rank - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * float(cap))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("words", F.sum("source_size").over(everything) * float(share))
    )
    upto = W.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    full = (
        levels.withColumn("full_words", F.sum("limit").over(upto))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.sum("weight").over(upto))
        .withColumn("full", F.col("full_words") + F.col("level") * F.col("open_weight") <= F.col("words"))
        .withColumn("left", F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0)))
        .withColumn("left_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    )
    share_of_rest = F.least("limit", F.col("left") * F.col("weight") / F.col("left_weight"))
    return full.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(share_of_rest).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = 17,
    weight: Column | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    ranges: int = RANGES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``."""
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source).alias("source"),
            n_words(docs[text]).alias("size"),
            (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))).alias("liking"),
        ),
        "mix-sizes",
    )
    summed = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liking")).alias("liked")
    )
    targets = source_targets(summed.select("source", "source_size"), weights, share, cap)
    per_source = targets.join(summed.select(F.col("source").alias("s"), "liked"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    wanted = F.when(F.col("liked") > 0, F.least(F.lit(float(cap)), F.col("liking") * F.col("target") / F.col("liked")))
    chance = F.col("wanted") - F.col("whole")
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (chance / (1 - chance))
    ranked = (
        _with(sized, per_source)
        .withColumn("wanted", F.coalesce(wanted, F.lit(0.0)))
        .withColumn("whole", F.floor("wanted"))
        .withColumn("rank", F.when(chance > 0, odds / (1 + odds)).otherwise(1.0))
        .withColumn("range", F.least(F.floor(F.col("rank") * ranges), F.lit(ranges - 1)).cast("int"))
        .withColumn("spare", F.when((F.col("whole") < cap) & (F.col("liking") > 0), F.col("size")).otherwise(F.lit(0)))
    )
    ranked = stored(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "range", "spare"), "mix-ranks")

    # Words of each range of ranks, those before it, and what the certain copies leave to fill.
    by_range = ranked.groupBy("source", "range").agg(
        F.sum("spare").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target")
    )
    within = W.partitionBy("source")
    before = within.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        by_range.withColumn("open", F.col("target") - F.sum("certain").over(within))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where("before <= open AND before + words > open")
        .select("source", F.col("range").alias("cut"), F.col("open"), F.col("before"))
    )
    placed = _with(ranked, cuts, how="left")
    ordered = within.orderBy("rank", "doc_id", "size", "spare")
    edge = placed.where(F.col("range") == F.col("cut"))
    so_far = F.col("before") + F.coalesce(F.sum("spare").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("extra", (F.col("spare") > 0) & (so_far + F.col("spare") / 2 <= F.col("open")))
    # A source without a cut takes every spare document: its target is all it may give.
    clear = placed.where(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).withColumn(
        "extra", (F.col("spare") > 0) & (F.col("range") < F.coalesce("cut", F.lit(ranges)))
    )
    copies = F.col("whole") + F.col("extra").cast("long")
    return clear.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _with(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    renamed = by_source.withColumnRenamed("source", "of_source")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it is taken.

    Rows of equal id and text form one entry; their copies are added up.
    """
    id_col = settings.get("id_col", "doc_id")
    text = settings.get("text", "text")
    counts = mix(docs, **settings).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(
        F.struct(F.lit(True).alias(PRESENT), *[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(settings.get("source", "source")).alias("of"),
        n_words(docs[text]).alias("words"),
    )
    same = (F.col("id").eqNullSafe(F.col("doc_id"))) & (F.col("of").eqNullSafe(F.col("source"))) & (F.col("words") == F.col("size"))
    joined = keyed.join(counts, same)
    place = F.when(F.col("rows") > 1, F.row_number().over(W.partitionBy("id", "of", "words").orderBy(F.xxhash64(F.col(f"row.{text}")))))
    spread = joined.withColumn("place", place) if _has_repeats(counts) else joined.withColumn("place", F.lit(1))
    each = F.floor(F.col("copies") / F.col("rows")) + (F.coalesce("place", F.lit(1)) <= F.col("copies") % F.col("rows")).cast("long")
    taken = spread.withColumn("each", each).where("each > 0")
    repeated = taken.select("row", F.explode(F.expr("sequence(1L, each)")).alias("n"))
    return repeated.select([F.col("row").getField(name).alias(name) for name in docs.columns])


def _has_repeats(counts: DataFrame) -> bool:
    return not counts.where("rows > 1").isEmpty()
