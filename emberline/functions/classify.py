"""Danger class and risk of an FWI value, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.constants import (
    DANGER_CLASSES,
    FIRE_HISTORY_RISK_CAP,
    FIRE_HISTORY_UPLIFT,
    RISK_WHEN_INVALID,
)
from emberline.functions.clean import finite
from emberline.session import local_table


def _by_class(fwi: str, field: int) -> str:
    """The given field of the class whose range holds ``fwi``."""
    values = [f"'{c[field]}'" if isinstance(c[field], str) else f"{c[field]}D" for c in DANGER_CLASSES]
    arms = [f"WHEN {fwi} < {upper[0]}D THEN {value}" for value, upper in zip(values, DANGER_CLASSES[1:])]
    return f"CASE {' '.join(arms)} ELSE {values[-1]} END"


def danger_class(fwi: str) -> str:
    """Class name of an FWI value within range."""
    return _by_class(fwi, 1)


def base_risk(fwi: str) -> str:
    """Risk of an FWI value within range, before any adjustment."""
    return _by_class(fwi, 2)


def color_code(fwi: str) -> str:
    """Display colour of an FWI value within range."""
    return _by_class(fwi, 3)


def adjusted_risk(base: str, historical_fire: str) -> str:
    """Base risk, raised and capped where fires burned before."""
    raised = f"least({FIRE_HISTORY_RISK_CAP}D, {base} * {FIRE_HISTORY_UPLIFT}D)"
    risk = f"CASE WHEN {historical_fire} = 1 THEN {raised} ELSE {base} END"
    return f"coalesce({finite(risk)}, {RISK_WHEN_INVALID}D)"


def class_rows() -> list[tuple]:
    """The class listing: order, bounds, name, risk, colour, description and range label."""
    uppers = [entry[0] for entry in DANGER_CLASSES[1:]] + [None]
    return [
        (i, low, high, name, risk, color, text, f"{low:.0f}-{high:.0f} FWI" if high else f"{low:.0f}+ FWI")
        for i, ((low, name, risk, color, text), high) in enumerate(zip(DANGER_CLASSES, uppers))
    ]


def danger_classes(spark: SparkSession) -> DataFrame:
    """The class listing as a table, least dangerous first."""
    schema = (
        "class_ord int, lo double, hi double, danger_class string, base_risk double, "
        "color string, description string, fwi_range string"
    )
    return local_table(spark, class_rows(), schema)
