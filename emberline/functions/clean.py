"""Missing-value policy: NaN, infinities and unreadable text become NULL once, and each
layer then states its own default.

The functions here and in the sibling modules return SQL expression text for
``selectExpr``; a whole formula then reaches Spark in one call.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.constants import FLOAT32_HISTORY, INPUT_RANGES, PRECIP_COLUMNS


def real(expression: str) -> str:
    """Make the decimal literals of an expression doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", expression)


def finite(value: str) -> str:
    """``value`` as a double, NULL unless it is a finite number.

    Spark orders NaN above every number, so one comparison drops NaN and +/-Inf.
    """
    number = f"try_cast({value} AS double)"
    return f"CASE WHEN abs({number}) < double('Infinity') THEN {number} END"


def bounded(value: str, name: str) -> str:
    """``value`` clipped to the accepted range of input ``name``, default if missing."""
    default, low, high = INPUT_RANGES[name]
    number = f"try_cast({value} AS double)"
    clipped = f"least(greatest({number}, {low}D), {high}D)"
    return f"coalesce(CASE WHEN abs({number}) < double('Infinity') THEN {clipped} END, {default}D)"


def narrow(value: str) -> str:
    """``value`` rounded to 32-bit precision, as a double; NULL if it is no number."""
    return f"cast(try_cast({value} AS float) AS double)"


def total_precip(columns: list[str], float32: bool = False) -> str:
    """Sum of the precipitation columns present; NULL if any of them is missing."""
    parts = [finite(narrow(c) if float32 else c) for c in PRECIP_COLUMNS if c in columns]
    return " + ".join(["0D", *parts])


def as_float32(df: DataFrame, columns: list[str] = FLOAT32_HISTORY) -> DataFrame:
    """Round the given columns to 32-bit precision, keeping the double type."""
    return df.selectExpr(*[f"{narrow(c)} AS `{c}`" if c in columns else f"`{c}`" for c in df.columns])


def index_inputs(df: DataFrame, keep: list[str], float32: bool = True) -> DataFrame:
    """The ``keep`` columns and the four index inputs, narrowed (if asked), defaulted, clipped.

    A column the table lacks counts as missing.
    """
    present = df.columns

    def known(name: str) -> str:
        source = name if name in present else "cast(NULL AS double)"
        return f"{bounded(narrow(source) if float32 else source, name)} AS {name}"

    rain = bounded(f"({total_precip(present, float32)})", "rain")
    return df.selectExpr(*keep, *map(known, ("temperature", "humidity", "wind_speed")), f"{rain} AS rain")


def _json_clean(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # NULL means "no value" and stays; only NaN and infinities turn into zero.
        return F.when(value.isNull() | (F.abs(value) < float("inf")), value).otherwise(
            F.lit(0.0).cast(dtype)
        )
    if isinstance(dtype, T.StructType):
        fields = [
            (_json_clean(value[f.name], f.dataType) if _has_float(f.dataType) else value[f.name]).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return F.transform(value, lambda item: _json_clean(item, dtype.elementType))


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def json_clean(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by 0.0 at any depth, guided by the schema."""
    floats = {f.name: _json_clean(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if _has_float(f.dataType)}
    return df.withColumns(floats)
