"""Filter interaction audit: what each filter removes in every order in which filters can be applied.

Every document becomes a mask with one bit per filter that it fails.  Documents of one part
(a source) and one mask are a cell; a part has at most ``2 ** filters`` of them, and nothing
but cells is looked at afterwards.  A recursive query then extends prefixes of filters by
each letter not yet used: a level joins the cells of its part, carries the bits applied so
far, and emits the numbers of the step that it has just added.

A document identical to one of smaller id is found by digests: rows of one id and text are
counted first, then rows of one text and part, so that a group of copies is a few rows before
anything is joined on its digest.

Labels, cells and orders grow with the documents or the parts, so their joins are dealt out by
key (merge hints): Spark would broadcast them by the size of their files, which is small.

Defined results: a null text is empty, a null source is the part ``''``; rows with a null id
fail no comparison of ids and have no label; rows of one id and text are equals, none is
smaller; of several labels of an id the greatest counts; other columns are not read; tables
without documents have no parts and so no rows.
"""

from __future__ import annotations

from itertools import count
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import WORD_PATTERN, stored

LEAST_WORDS = 200
LEAST_DISTINCT_PCT = 50
MOST_CAPITALS_PCT = 2
SYMBOLS = "[#$%&*|]"
# Letters of the filters on a text alone, in the order of their bits; the filter on copies comes after them.
TEXT_FILTERS = "ABCD"
FILTERS = TEXT_FILTERS + "E"
# A label's rows are joined in so many places, so that no id fills one task.
SALTS = 8


def text_failures(text: Column) -> dict[str, Column]:
    """The filters on a text alone: whether it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS_PCT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failure_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters that they fail."""
    whole = F.coalesce(F.col(text), F.lit(""))
    mask = sum(
        (F.when(failed, 1 << place).otherwise(0) for place, failed in enumerate(text_failures(whole).values())), F.lit(0)
    )
    rows = (
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
            mask.cast("int").alias("mask"),
        )
        .groupBy("id", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )
    # Written out, since it is read more than once and no text shall be.
    marked = _labelled(stored(rows, "filter-audit-rows"), labels, id_col)

    # Per text and part: how many rows, how many of them have an id, and how many have the least one.
    kinds = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("at_least"),
    )
    firsts = (
        kinds.groupBy("digest").agg(F.min("least").alias("first"), F.sum("named").alias("all_named"))
        .where("all_named > 1").select("digest", "first")
    )
    own = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copies = F.when(F.col("first").isNotNull(), F.col("named") - own).otherwise(0)
    split = kinds.join(firsts, "digest", "left").withColumn("copies", copies)
    later = F.lit(1 << len(TEXT_FILTERS))
    cells = split.select(
        "part", "good", "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
                F.struct(F.col("mask").bitwiseOR(later).alias("mask"), F.col("copies").alias("n")),
            )
        ),
    )
    return cells.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1) of their id."""
    def flag(name: str) -> Column:
        return F.max((F.coalesce(F.col(name), F.lit(0)) == 1).cast("int"))

    known = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
        .where("good > 0 OR toxic > 0")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    # SALTS rows a label weigh far more than the file by whose size Spark would choose to broadcast them.
    named = rows.where("id IS NOT NULL").withColumn("salt", salt).join(known.hint("merge"), ["id", "salt"], "left").drop("salt")
    nameless = rows.where("id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return named.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("good", "toxic")}).unionByName(nameless)


_views = count()


def prefix_steps(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The last step of every ordered choice of filters: one row per part and prefix.

    ``part, prefix, letter, step`` and the numbers of that step.  There are 325 prefixes of
    five letters; with ``n`` letters their number grows as ``n!``.
    """
    spark = cells.sparkSession
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    # Read at each level of the recursion.
    view = f"filter_audit_cells_{next(_views)}"
    stored(by_part, "filter-audit-cells").hint("merge").createOrReplaceTempView(view)
    bits = ", ".join(f"struct('{letter}' AS letter, {1 << place} AS bit)" for place, letter in enumerate(letters))

    def total(what: str, condition: str) -> str:
        return f"aggregate(c.cells, 0L, (t, x) -> t + if({condition}, x.{what}, 0L))"

    removed = "x.mask & f.bit <> 0 AND x.mask & p.applied = 0"
    query = f"""
WITH RECURSIVE steps (part, prefix, applied, letter, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {view}
  UNION ALL
  SELECT p.part, concat(p.prefix, f.letter), p.applied | f.bit, f.letter, p.step + 1,
    {total("n", "x.mask & (p.applied | f.bit) = 0")}, {total("n", removed)},
    {total("n", "x.mask & f.bit <> 0 AND x.mask & p.applied <> 0")}, {total("n", "x.mask = f.bit")},
    {total("good", removed)}, {total("toxic", removed)}
  FROM (
    SELECT part, prefix, applied, step, explode(filter(array({bits}), l -> l.bit & applied = 0)) AS f FROM steps
  ) p JOIN {view} c ON c.part = p.part
)
SELECT part, prefix, letter, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM steps WHERE step > 0
"""
    # The number of rows grows with the parts; the limit is meant for recursions that do not end.
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return stored(spark.sql(query), "filter-audit-steps")
    finally:
        spark.conf.set(name, before)
        spark.catalog.dropTempView(view)


def audit_orders(steps: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Every step of every complete order, from the steps of prefixes."""
    n = len(letters)
    # An order of all letters has each of its prefixes; a prefix of k letters lies in (n - k)! orders.
    shares = F.element_at(F.array(*[F.lit(factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * shares).alias("shapley"))
    orders = (
        steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("prefix", F.expr("left(filter_order, at)"))
    )
    return (
        orders.join(steps.hint("merge"), ["part", "prefix"]).join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``, with what they cost in labelled documents."""
    return audit_orders(prefix_steps(failure_cells(docs, labels)))
