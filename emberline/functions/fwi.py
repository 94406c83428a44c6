"""Fire Weather Index codes as SQL expressions.

The three moisture codes are recurrences: each day's value needs the day before.  Most of
a day's formula depends on that day's weather alone, so it is split in two:

* ``day_terms`` - everything that needs only the weather.  Plain columns, evaluated row by
  row in generated code, in parallel over all days.
* ``CODE_STEPS`` - what is left of the recurrence.  These are the steps of three independent
  ``aggregate`` folds over a cell's ordered days.

Equations follow Van Wagner & Pickett (1985), with these deliberate parity choices: the duff
code uses the drought-code month factors and adds the rain term, the drought code adds the
whole evaporation term, wind is taken as given, and one month applies to the whole window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberline.constants import (
    INDEX_DEFAULTS,
    INPUT_RANGES,
    MONTH_FACTOR_OTHER,
    MONTH_FACTORS,
    START_CODES,
)
from emberline.functions.clean import bounded, finite, real

INDEX_NAMES = ["ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr"]


def month_factor(month: int | str) -> str:
    """Day-length factor of a month number, given as a number or a column name."""
    if isinstance(month, int):
        return f"{MONTH_FACTORS[month - 1] if 1 <= month <= 12 else MONTH_FACTOR_OTHER}D"
    table = ", ".join(f"{v}D" for v in MONTH_FACTORS)
    return f"coalesce(get(array({table}), cast({month} AS int) - 1), {MONTH_FACTOR_OTHER}D)"


def day_terms(month: int | str, day: str = "") -> dict[str, str]:
    """The weather-only terms of one day.  ``day`` is a prefix such as ``d.``; inputs are clean.

    A NULL term says "does not apply today": no effective rain, or too cold to dry.
    """
    t, h, w, r = (day + c for c in ("temperature", "humidity", "wind_speed", "rain"))
    factor = month_factor(month)
    saturation = f"exp(({h} - 100) / 10)"
    warmth = f"0.18 * (21.1 - {t}) * (1 - exp(-0.115 * {h}))"
    heat = f"0.581 * exp(0.0365 * {t})"

    def remaining(share: str) -> str:
        rate = f"0.424 * (1 - power({share}, 1.7)) + 0.0694 * sqrt({w}) * (1 - power({share}, 8))"
        return f"power(10, -({rate}) * {heat})"

    terms = {
        # Fine fuels: what effective rain adds, the two equilibria, and the share of the
        # distance to equilibrium that remains after a day of drying or wetting.
        "soak_gain": f"CASE WHEN {r} > 0.5 THEN 42.5 * ({r} - 0.5) * (1 - exp(-6.93 / ({r} - 0.5))) END",
        "soak_root": f"CASE WHEN {r} > 0.5 THEN sqrt({r} - 0.5) END",
        "dry_level": f"0.942 * power({h}, 0.679) + 11 * {saturation} + {warmth}",
        "wet_level": f"0.618 * power({h}, 0.753) + 10 * {saturation} + {warmth}",
        "dry_left": remaining(f"({h} / 100)"),
        "wet_left": remaining(f"((100 - {h}) / 100)"),
        # Duff: drying is linear in the warmth above -1.1 degrees.
        "duff_rain": f"CASE WHEN {r} > 1.5 THEN 0.92 * {r} - 1.27 END",
        "duff_drying": f"CASE WHEN {t} >= -1.1 THEN 1.894E-4D * ({t} + 1.1) * (100 - {h}) * ({factor}) END",
        # Drought: evaporation starts strictly above -2.8 degrees; exactly there nothing is added.
        "drought_rain": f"CASE WHEN {r} > 2.8 THEN 3.937 * (0.83 * {r} - 1.27) / 800 END",
        "drought_drying": (
            f"CASE WHEN {t} > -2.8 THEN greatest(0D, 0.36 * ({t} + 2.8) + ({factor}))"
            f" WHEN {t} = -2.8 THEN 0D END"
        ),
    }
    return {name: real(term) for name, term in terms.items()}


def fuel_moisture(ffmc: str) -> str:
    """Moisture content that a fine-fuel code stands for."""
    return f"(147.2 * (101 - {ffmc}) / (59.5 + {ffmc}))"


def _ffmc_step() -> str:
    moisture = fuel_moisture("code")
    flood = f"CASE WHEN {moisture} > 150 THEN 0.0015 * power({moisture} - 150, 2) * day.soak_root ELSE 0D END"
    soaked = f"least(250D, {moisture} + day.soak_gain * exp(-100 / (251 - {moisture})) + {flood})"
    start = f"CASE WHEN day.soak_gain IS NULL THEN {moisture} ELSE {soaked} END"
    # The level after rain is used several times: bound to a name by a one-element transform.
    end = f"""get(transform(array({start}), level -> CASE
        WHEN level > day.dry_level THEN day.dry_level + (level - day.dry_level) * day.dry_left
        WHEN level < day.wet_level THEN day.wet_level - (day.wet_level - level) * day.wet_left
        ELSE level END), 0)"""
    _, low, high = INPUT_RANGES["ffmc"]
    # 59.5 (250 - m) / (147.2 + m), written so that m appears once.
    return f"least(greatest(59.5 * (397.2 / (147.2 + {end}) - 1), {low}), {high})"


def _dmc_step() -> str:
    code = f"least(code, {INPUT_RANGES['dmc'][2]})"
    slope = (
        f"CASE WHEN {code} <= 20 + 280 * exp(-0.023 * {code}) THEN 100 / (0.5 + 0.3 * {code})"
        f" ELSE 14 - 1.3 * ln({code} + 1) END"
    )
    wetted = f"greatest(0D, {code} + 1000 * day.duff_rain / (48.77 + ({slope}) * day.duff_rain))"
    start = f"CASE WHEN day.duff_rain IS NULL THEN {code} ELSE {wetted} END"
    # Frozen days keep yesterday's code, rain included.
    return f"CASE WHEN day.duff_drying IS NULL THEN {code} ELSE greatest(0D, {start} + day.duff_drying) END"


def _dc_step() -> str:
    code = f"least(code, {INPUT_RANGES['dc'][2]})"
    wetted = f"greatest(0D, {code} - 400 * ln(1 + day.drought_rain * exp({code} / 400)))"
    start = f"CASE WHEN day.drought_rain IS NULL THEN {code} ELSE {wetted} END"
    # Frozen days keep yesterday's code, rain included.
    return f"CASE WHEN day.drought_drying IS NULL THEN {code} ELSE {start} + day.drought_drying END"


# Each code after one day, from yesterday's ``code`` and the terms of ``day``.
CODE_STEPS = {"ffmc": real(_ffmc_step()), "dmc": real(_dmc_step()), "dc": real(_dc_step())}


def folded(series: str, name: str) -> str:
    """A code at the end of an ordered array of day terms."""
    return f"aggregate({series}, {START_CODES[name]}D, (code, day) -> {CODE_STEPS[name]})"


def or_default(value: str, name: str) -> str:
    """An index value, or its default where it is not a finite number."""
    return f"coalesce({finite(value)}, {INDEX_DEFAULTS[name]}D) AS {name}"


def fold_series(cells: DataFrame) -> DataFrame:
    """Replace ``series`` by the accumulated codes and the last day's wind and date."""
    others = [c for c in cells.columns if c != "series"]
    return cells.selectExpr(
        *others,
        "element_at(series, -1).file_date AS last_date",
        "element_at(series, -1).wind_speed AS last_wind",
        *[f"{folded('series', name)} AS {name}" for name in CODE_STEPS],
    ).selectExpr(*others, "last_date", "last_wind", *[or_default(name, name) for name in CODE_STEPS])


SPREAD = real(
    f"0.208 * exp(0.05039 * wind_in) * 91.9 * exp(-0.1386 * {fuel_moisture('ffmc_in')})"
    f" * (1 + power({fuel_moisture('ffmc_in')}, 5.31) / 4.93E7D)"
)
FUEL_SHARE = "(0.8 * dc_in / (dmc_in + 0.4 * dc_in + 0.001))"
BUILDUP = real(
    f"greatest(0D, CASE WHEN dmc_in <= 0.4 * dc_in THEN {FUEL_SHARE} * dmc_in"
    f" ELSE dmc_in - (1 - {FUEL_SHARE}) * (0.92 + power(0.0114 * dmc_in, 1.7)) END)"
)
INTENSITY = real(
    "0.1 * isi_in * CASE WHEN bui_in <= 80 THEN 0.626 * power(bui_in, 0.809) + 2"
    " ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui_in)) END"
)
SCALED = real("CASE WHEN intensity > 1 THEN exp(2.72 * power(0.434 * ln(intensity), 0.647)) ELSE intensity END")


def with_fire_indices(codes: DataFrame) -> DataFrame:
    """Add ISI, BUI, FWI and DSR to accumulated codes.

    Every step names its result as a column and the next one reads that column.  Written as
    one nested expression the formulas would repeat their inputs many times over.
    """
    kept = codes.columns
    inputs = {"wind_in": ("last_wind", "wind_speed"), "ffmc_in": ("ffmc",) * 2, "dmc_in": ("dmc",) * 2, "dc_in": ("dc",) * 2}
    parts = codes.selectExpr(*kept, *[f"{bounded(*source)} AS {name}" for name, source in inputs.items()]).selectExpr(
        *kept, or_default(SPREAD, "isi"), or_default(BUILDUP, "bui")
    )
    rated = (
        parts.selectExpr("*", f"{bounded('isi', 'isi')} AS isi_in", f"{bounded('bui', 'bui')} AS bui_in")
        .selectExpr(*kept, "isi", "bui", f"{INTENSITY} AS intensity")
        .selectExpr(*kept, "isi", "bui", or_default(SCALED, "fwi"))
    )
    return rated.selectExpr("*", "0.0272D * power(fwi, 1.77D) AS dsr")
