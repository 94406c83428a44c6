"""Quality rules on lines: bad lines go first, then documents that lost too much text.

Every line with a word is held against three groups of rules:

* punctuation: a line ends like a sentence, or is long and holds a sentence's end;
* navigation: menus and tables, recognised by separators, or a few words without an end;
* boilerplate: set phrases of web pages, decoration symbols, lines in capitals.

Lines that fail one go.  A document is then rejected if it lost more than ``max_lost`` of
its word characters, or if its base counts are bad.

Defined results: a null text counts as empty (no words, rejected, null stays null); blank
lines are kept as they are and judged by nothing; a null doc_id is carried along; repeated
rows are judged each; further columns stay untouched whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberline.llm.common import BLANKS, PRESENT, arrow_schema, map_rows, small_batches, words_of

# Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20

# Values of the line rules.
SENTENCE_ENDS = frozenset(".!?:;…。！？")
CLOSERS = "\"'”»)]"
INNER_END = re.compile(r"[.!?…][ \t]")
LONG_LINE = 8
SEPARATORS = {b"|", b">", b"\xc2\xbb", b"\xe2\x80\xa2", b"\xc2\xb7", b"/", b"::"}
MAX_SEPARATOR_PCT = 15
MENU_WORDS = 3
MAX_SYMBOL_PCT = 25
MAX_CAPITAL_PCT = 60
PHRASES = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "click here",
    "subscribe to our",
    "sign up for",
    "read more",
    "share this",
    "back to top",
    "lorem ipsum",
    "skip to content",
)
MAX_LOST = 0.5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
VERDICT = f"{COUNTS}, n_lines long, n_lines_removed long, lost_chars long, kept boolean"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words inside a window of words that occurs twice or more; exact.

    A window's number is made of its words' numbers, at once where that fits 64 bits, else by
    numbering ever longer pieces; so a long text costs a few sorts and no tuples.
    """
    numbers = {word: number for number, word in enumerate(dict.fromkeys(words))}
    if len(words) <= window or len(numbers) == len(words):
        return 0
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(numbers) ** window < 2**63:
        joined = codes[: len(codes) - window + 1].copy()
        for step in range(1, window):
            joined = joined * len(numbers) + codes[step : len(codes) - window + 1 + step]
        ordered = np.sort(joined)
        if not (ordered[1:] == ordered[:-1]).any():
            return 0
        codes = np.unique(joined, return_inverse=True)[1]
    else:
        length, span = 1, len(numbers)
        while length < window:
            step = min(length, window - length)
            distinct, codes = np.unique(codes[: len(codes) - step] * span + codes[step:], return_inverse=True)
            length, span = length + step, len(distinct)
    repeated = np.bincount(codes)[codes] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def failed_rule(line: str, words: list[bytes]) -> str | None:
    """The group of rules that a line of these words fails, or None; a line without a word fails none."""
    if not words:
        return None
    stripped = line.strip(BLANKS)
    ended = stripped.rstrip(CLOSERS)[-1:] in SENTENCE_ENDS
    separators = sum(map(SEPARATORS.__contains__, words))
    if 100 * separators > MAX_SEPARATOR_PCT * len(words) or (not ended and len(words) <= MENU_WORDS):
        return "navigation"
    if any(map(stripped.lower().__contains__, PHRASES)):
        return "boilerplate"
    if 100 * sum(map(stripped.count, SYMBOLS)) > MAX_SYMBOL_PCT * len(words):
        return "boilerplate"
    if len(words) > MENU_WORDS and 100 * sum(map(bytes.isupper, words)) > MAX_CAPITAL_PCT * len(words):
        return "boilerplate"
    if not ended and (len(words) < LONG_LINE or not INNER_END.search(stripped)):
        return "punctuation"
    return None


def _word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def judge(text: str | None, max_lost: float = MAX_LOST) -> tuple:
    """The values of VERDICT and the cleaned text of one document."""
    if text is None:
        return (0, 0, 0, 0, 0, True, 0, 0, 0, False, None)
    lines = text.split("\n")
    by_line = list(map(words_of, lines))
    words = list(chain.from_iterable(by_line))
    chars = _word_chars(text)
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * len(words)

    real = [line for line, found in zip(lines, by_line) if found]
    verdicts = {line: failed_rule(line, found) for line, found in dict(zip(lines, by_line)).items() if found}
    kept = [line for line in lines if verdicts.get(line) is None]
    lost = sum(_word_chars(line) for line in real if verdicts[line])
    fine = not base_failed and lost <= max_lost * chars
    removed = len(lines) - len(kept)
    cleaned = "\n".join(kept) if removed else text
    return (len(words), chars, symbols, len(real) - len(verdicts), repeats, base_failed, len(real), removed, lost, fine, cleaned)


def with_verdicts(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with the columns of VERDICT and the ``cleaned`` text."""
    packed = docs.select(F.struct(F.lit(True).alias(PRESENT), *[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    made = StructType([*packed.schema.fields, *StructType.fromDDL(f"{VERDICT}, cleaned string").fields])
    kinds = arrow_schema(docs, f"{VERDICT}, cleaned string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = zip(*(judge(value.as_py(), max_lost) for value in batch.column(0).field(text)))
            values = [pa.array(column, kind.type) for column, kind in zip(judged, kinds)]
            if values:
                yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["row", *kinds.names])

    return small_batches(packed).mapInArrow(run, made)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The id and the values of VERDICT for every row of ``docs``."""
    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text)),
        lambda doc_id, value: [(doc_id, *judge(value, max_lost)[:-1])],
        f"doc_id long, {VERDICT}",
        flush=5_000,
    )


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str | None = None, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with their bad lines removed; the columns of ``docs``.

    ``n_chars`` names a column that is to hold the length of the cleaned text.
    """
    kept = with_verdicts(docs, text, max_lost).where("kept")
    replaced = {text: F.col("cleaned")} | ({n_chars: F.length("cleaned").cast(docs.schema[n_chars].dataType)} if n_chars else {})
    return kept.select([replaced.get(name, F.col("row").getField(name)).alias(name) for name in docs.columns])
