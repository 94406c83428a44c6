"""Secret scan over a trigram index: spans of what looks like a password, a key or a token.

1. Each rule's regular expression gives a Boolean query over trigrams (``trigrams.py``).
2. The index has a row per document and trigram, for the trigrams of the rules, laid out by
   trigram so that a query reads the postings of its own trigrams only.
3. The postings of a rule are intersected: a document is a candidate if it is in all postings
   of one alternative.  Only candidates are brought together with their text and searched.
4. Rules without a mandatory trigram are searched for in every text.

Built-in functions only.  A match is placed by the lengths of the text's pieces between
matches, summed up over the matches of a document and rule.

Patterns must mean the same to Spark and to Python's parser: literals, sets, groups,
alternatives and repeats.  A repeat of sets is matched as far as it reaches, so a least length
written as ``{24,}`` finds the same spans as a filter on all runs.

Defined results: a null text is empty and holds nothing; every row is searched on its own, so
repeated rows and null ids get a result each; other columns are not read.  Matches of one
rule do not overlap, leftmost first; those of different rules may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.llm.common import stored
from emberline.llm.trigrams import trigram_query

# Postings of one trigram are laid out in so many places.
POSTING_PARTS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` of it has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    """A pattern with each letter in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_VALUE = "[A-Za-z0-9+/_.=-]"
_BLANK = r"\x20\x09-\x0D"
# The first three kinds.
BASE_RULES = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?({_VALUE}+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
RULES = BASE_RULES + (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", f"[a-z]://[^{_BLANK}/:@]+:([^{_BLANK}/:@]+)@", 1, 3),
    Rule("bearer", f"{either_case('bearer')}\\x20+({_VALUE}{{20,}})", 1, 20),
)


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``trigram, row`` for ``texts`` (``row, text``): which rows hold which of the trigrams."""
    # A column of its own, so that the text is folded once and not once per trigram.
    folded = texts.select("row", F.lower("text").alias("low"))
    ordered = sorted(trigrams)
    held = folded.select("row", F.posexplode(F.array(*[F.contains("low", F.lit(t)) for t in ordered])).alias("place", "held"))
    names = F.array(*[F.lit(t) for t in ordered])
    postings = held.where("held").select(F.get(names, F.col("place")).alias("trigram"), "row")
    laid = postings.repartition(F.col("trigram"), F.pmod("row", F.lit(POSTING_PARTS))).sortWithinPartitions("trigram", "row")
    return stored(laid, "secret-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``row, kinds``: the rules whose Boolean query the postings of a row fulfil."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    wanted = sorted(set().union(*(one for query in queries.values() for one in query)))
    by_row = index.where(F.col("trigram").isin(wanted)).groupBy("row").agg(F.collect_set("trigram").alias("held"))

    def fulfilled(query) -> Column:
        one_of = F.lit(False)
        for alternative in sorted(query, key=sorted):
            all_of = F.lit(True)
            for trigram in sorted(alternative):
                all_of &= F.array_contains("held", trigram)
            one_of |= all_of
        return one_of

    kinds = F.array_compact(F.array(*[F.when(fulfilled(query), F.lit(kind)) for kind, query in queries.items()]))
    return by_row.select("row", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _pieces(rules: list[tuple[int, Rule]]) -> Column:
    """One entry per rule to be searched for: lengths of the text between matches, of matches, and of what counts."""
    def lengths(strings: Column) -> Column:
        return F.transform(strings, F.length)

    def entry(place: int, rule: Rule) -> Column:
        def matches(group: int) -> Column:
            return lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group)))

        between = lengths(F.split("text", rule.pattern, -1))
        parts = F.arrays_zip(between.alias("gap"), matches(0).alias("length"), matches(rule.group).alias("counted"))
        found = F.struct(F.lit(place).alias("kind"), F.lit(rule.least).alias("least"), parts.alias("parts"))
        return F.when(F.array_contains("kinds", rule.kind), found)

    return F.array_compact(F.array(*[entry(place, rule) for place, rule in rules]))


def _searched(texts: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """The matches in ``texts`` (``row, text, kinds``): ``row, kind, least, pos, gap, length, counted``."""
    per_rule = texts.select("row", F.explode(_pieces(rules)).alias("found")).select("row", "found.*")
    parts = per_rule.select("row", "kind", "least", F.posexplode("parts").alias("pos", "part"))
    return parts.select("row", "kind", "least", "pos", "part.*").where("length IS NOT NULL")


def number_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, text``, written out, so that a row keeps its number."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return stored(numbered, "secret-rows")


def secret_spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row, kind, start, stop`` for ``texts`` (``row, text``); ``kind`` is the place in ``rules``, ``stop`` lies behind the match."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    indexed = [(place, rule) for place, rule in enumerate(rules) if frozenset() not in queries[place]]
    unindexed = [(place, rule) for place, rule in enumerate(rules) if frozenset() in queries[place]]
    found = []
    if indexed:
        trigrams = set().union(*(one for place, _ in indexed for one in queries[place]))
        chosen = stored(candidates(build_index(texts, sorted(trigrams)), tuple(rule for _, rule in indexed)), "secret-candidates")
        found.append(_searched(texts.select("row", "text").join(chosen, "row"), indexed))
    if unindexed:
        hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(rule.pattern), F.lit(rule.kind)) for _, rule in unindexed]))
        found.append(_searched(texts.select("row", "text", hits.alias("kinds")).where(F.size("kinds") > 0), unindexed))
    parts = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    upto = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = parts.repartition("row").withColumn("stop", F.sum(F.col("gap") + F.col("length")).over(upto))
    kept = placed.where("counted >= least")
    return kept.select("row", "kind", (F.col("stop") - F.col("length")).alias("start"), "stop")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``: spans are (start, kind, stop, name), in order."""
    texts = number_rows(docs, id_col, text)
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    span = F.struct("start", "kind", "stop", F.get(names, F.col("kind")).alias("name"))
    by_row = secret_spans(texts, rules).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,name:string>>")
    return texts.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")
