"""Counts and statistics of a scoring run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.constants import DANGER_CLASSES
from emberline.functions.classify import class_rows
from emberline.operators.scoring import REJECT_REASONS
from emberline.session import local_table


def count_column(class_name: str) -> str:
    return class_name.lower().replace(" ", "_") + "_count"


def class_counts(ok: Column) -> list[Column]:
    """One count per danger class, zero when the class does not occur."""
    return [
        F.count_if(ok & (F.col("danger_class") == name)).alias(count_column(name))
        for _, name, *_ in DANGER_CLASSES
    ]


def run_metrics() -> dict[str, Column]:
    """Totals, risk range, class counts and rejects of scored rows, as aggregates by name."""
    ok = F.col("reject_reason").isNull()
    risk = F.when(ok, F.col("daily_fire_risk"))
    none = F.lit(0.0)
    return {
        "total_locations": F.count(F.lit(1)),
        "processed_successfully": F.count_if(ok),
        "processing_errors": F.count_if(~ok),
        "min_risk": F.coalesce(F.min(risk), none),
        "max_risk": F.coalesce(F.max(risk), none),
        "mean_risk": F.coalesce(F.avg(risk), none),
        **{count_column(name): count for (_, name, *_), count in zip(DANGER_CLASSES, class_counts(ok))},
        **{f"rejected_{reason}": F.count_if(F.col("reject_reason") == reason) for reason in REJECT_REASONS},
    }


def _nested(metrics: DataFrame) -> DataFrame:
    totals = ["total_locations", "processed_successfully", "processing_errors"]
    inner = ["min_risk", "max_risk", "mean_risk", *(count_column(name) for _, name, *_ in DANGER_CLASSES)]
    return metrics.select(*totals, F.struct(*inner).alias("risk_statistics"))


def run_stats(scored: DataFrame) -> DataFrame:
    """One row of totals, risk range and class counts, from a single pass over the run."""
    return _nested(scored.agg(*[metric.alias(name) for name, metric in run_metrics().items()]))


def observed_stats(spark: SparkSession, seen: dict) -> DataFrame:
    """The same from ``run_metrics`` that were gathered while the rows were written."""
    fields = [f"{name} {'double' if isinstance(value, float) else 'bigint'}" for name, value in seen.items()]
    return _nested(local_table(spark, [tuple(seen.values())], ", ".join(fields)))


def observed_rejects(spark: SparkSession, seen: dict) -> DataFrame:
    """Rejected rows by reason, from the same metrics."""
    rows = [(reason, seen[f"rejected_{reason}"]) for reason in REJECT_REASONS]
    return local_table(spark, rows, "reject_reason string, n_rows bigint").where("n_rows > 0")


def class_report(predictions: DataFrame) -> DataFrame:
    """The danger-class listing with how many predictions fall into each class.

    Six counters over one pass, then one row per counter; classes without cells show zero.
    """
    counts = predictions.agg(*class_counts(F.lit(True)))
    rows = [
        f"struct('{name}' AS danger_class, '{label}' AS fwi_range, '{color}' AS color,"
        f" '{text}' AS description, {count_column(name)} AS n_cells)"
        for _, _, _, name, _, color, text, label in class_rows()
    ]
    return counts.selectExpr(f"inline(array({', '.join(rows)}))")


def rejects_by_reason(scored: DataFrame) -> DataFrame:
    """How many rows were rejected, by reason."""
    return (
        scored.filter(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count("*").alias("n_rows"))
    )


def rejects_report(scored: DataFrame, bad_files: DataFrame, bad_payloads: DataFrame | None = None) -> DataFrame:
    """Rejected rows and payloads by reason, and one line per file that was skipped as a whole."""
    rows = rejects_by_reason(scored).selectExpr("'row' AS level", "'' AS file_name", "reject_reason", "n_rows")
    files = bad_files.selectExpr(
        "'file' AS level", "file_name", "'unreadable_number' AS reject_reason", "cast(NULL AS bigint) AS n_rows"
    )
    if bad_payloads is None:
        return rows.unionByName(files)
    payloads = rejects_by_reason(bad_payloads).selectExpr("'payload' AS level", "'' AS file_name", "reject_reason", "n_rows")
    return rows.unionByName(files).unionByName(payloads)


def training_records(run_log: DataFrame) -> DataFrame:
    """Cells scored by the latest run in the run log; 0 if none was logged."""
    last = F.max_by("processed_successfully", "run_ts")
    return run_log.agg(F.coalesce(last, F.lit(0)).alias("training_records"))
