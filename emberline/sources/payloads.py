"""Landed station payloads: one nested JSON object per station and run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import PAYLOAD_FIELDS, PAYLOAD_RENAMES, PAYLOAD_TEXT_FIELDS, SNAPSHOT_ZONE

# Landing format: JSON lines; Spark hands the nested payload over as its JSON text.
LANDING_SCHEMA = "station string, fetched_at timestamp, payload string"

WEATHER_COLUMNS = [
    *(PAYLOAD_RENAMES.get(name, name) for _, name, _ in PAYLOAD_FIELDS),
    *(name for _, name, _ in PAYLOAD_TEXT_FIELDS),
    "timestamp_utc",
]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files as a batch."""
    return spark.read.schema(LANDING_SCHEMA).json(path)


def stream_payloads(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed payload files as a stream."""
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table yet."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def _shape() -> str:
    """The parts of a payload that are read, each leaf still a variant.

    One cast to this struct looks at every object once.  A key that is absent is NULL, one that
    is JSON null is a variant that is null, and an object of another kind counts as absent.
    """
    parts: dict[str, list[str]] = {}
    for path, _, _ in PAYLOAD_FIELDS:
        top, *inner = path.split(".")[1:]
        parts.setdefault(top, []).extend(inner)
    fields = [
        f"`{top}`: struct<{', '.join(f'`{name}`: variant' for name in inner)}>" if inner else f"`{top}`: variant"
        for top, inner in parts.items()
    ]
    return f"struct<{', '.join(fields)}, weather: array<variant>, dt: variant>"


PARTS = f"try_variant_get({{document}}, '$', '{_shape()}')"


def _of_parts(path: str, dtype: str) -> tuple[str, str]:
    """A leaf of ``parts`` as it is, and its value."""
    leaf = "parts." + ".".join(f"`{step}`" for step in path.split(".")[1:])
    return leaf, f"try_variant_get({leaf}, '$', '{dtype}')"


def _of_document(path: str, dtype: str) -> tuple[str, str]:
    """The same of a stored ``document``, where each leaf is a column that the scan reads."""
    return f"try_variant_get(document, '{path}', 'variant')", f"try_variant_get(document, '{path}', '{dtype}')"


def _columns(leaf: Callable[[str, str], tuple[str, str]], first_weather: Callable[[str], tuple[str, str]], fetched_at: str) -> list[str]:
    """The flat columns: a default if a key is absent, NULL if it is JSON null or does not fit.

    A text of the weather has its default only if there is no first entry.
    """
    def column(found: tuple[str, str], default: str, name: str) -> str:
        return f"CASE WHEN {found[0]} IS NULL THEN {default} ELSE {found[1]} END AS {name}"

    return [
        *(column(leaf(path, "double"), f"{default}D", name) for path, name, default in PAYLOAD_FIELDS),
        *(column(first_weather(key), f"'{default}'", name) for key, name, default in PAYLOAD_TEXT_FIELDS),
        column(leaf("$.dt", "bigint"), f"unix_timestamp(cast({fetched_at} AS timestamp))", "timestamp_utc"),
    ]


# Unreadable text yields no variant; text that is no object yields one of another kind.
OBJECT = "schema_of_variant(try_parse_json(payload)) LIKE 'OBJECT%'"


def flatten_payloads(landed: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Replace ``payload`` by its flat weather columns; text that is no JSON object is dropped.

    See ``unreadable_payloads`` for what is dropped.  Each payload is parsed once.
    """
    kept = [c for c in landed.columns if c != "payload"]
    # Text that is no object has no parts.  A filter on an expression would be evaluated below
    # and again above it; one on what ``explode`` yields stays where it is.
    parts = landed.selectExpr(*kept, f"explode(array({PARTS.format(document='try_parse_json(payload)')})) AS parts")
    def first_weather(key: str) -> tuple[str, str]:
        return "get(parts.weather, 0)", f"try_variant_get(get(parts.weather, 0), '$.{key}', 'string')"

    return parts.where("parts IS NOT NULL").selectExpr(*kept, *_columns(_of_parts, first_weather, fetched_at))


def documents(landed: DataFrame) -> DataFrame:
    """Replace ``payload`` by ``document``, the same as a variant; only objects are kept.

    Written as Parquet, the documents of a file are shredded: what they have in common lies in
    typed columns of its own.  That holds as long as all of them are objects.
    """
    kept = [c for c in landed.columns if c != "payload"]
    parsed = landed.selectExpr(*kept, "explode(array(try_parse_json(payload))) AS document")
    return parsed.where("try_variant_get(document, '$', 'struct<dt: variant>') IS NOT NULL")


def flatten_documents(stored: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Replace ``document`` by its flat weather columns; the scan reads no other part of it."""
    kept = [c for c in stored.columns if c != "document"]

    def first_weather(key: str) -> tuple[str, str]:
        return "try_variant_get(document, '$.weather[0]', 'variant')", f"try_variant_get(document, '$.weather[0].{key}', 'string')"

    return stored.selectExpr(*kept, *_columns(_of_document, first_weather, fetched_at))


def unreadable_payloads(landed: DataFrame) -> DataFrame:
    """Payloads that are no JSON object: the columns besides ``payload`` and a ``reject_reason``."""
    kept = [c for c in landed.columns if c != "payload"]
    reason = (
        "CASE WHEN try_parse_json(payload) IS NULL THEN 'payload_no_json'"
        f" WHEN NOT ({OBJECT}) THEN 'payload_no_object' END AS reject_reason"
    )
    return landed.selectExpr(*kept, reason).filter("reject_reason IS NOT NULL")


def daily_columns(flat: DataFrame) -> DataFrame:
    """Rename flat payload columns to those of the daily weather table."""
    return flat.withColumnsRenamed(PAYLOAD_RENAMES)


def local_date_text(instant: Column) -> Column:
    """A UTC instant as wall-clock text in the snapshot's zone."""
    return F.date_format(F.from_utc_timestamp(instant, SNAPSHOT_ZONE), "yyyy-MM-dd HH:mm:ss")
