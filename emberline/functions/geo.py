"""Map projection, distances and province lookup as SQL expressions."""

from __future__ import annotations

import math

from emberline.constants import LAMBERT, PROVINCE_BOXES, PROVINCE_PRIORITY


def _lambert_parameters() -> dict[str, float]:
    """Cone constants of the projection (Snyder, USGS PP 1395, 1987, eq. 14-15 and 15-7 to 15-10)."""
    flattening = 1.0 / LAMBERT["inverse_flattening"]
    ecc = math.sqrt(flattening * (2.0 - flattening))

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1.0 - (ecc * math.sin(lat)) ** 2)

    def t(lat: float) -> float:
        s = ecc * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1.0 - s) / (1.0 + s)) ** (ecc / 2)

    low, high = (math.radians(p) for p in LAMBERT["standard_parallels"])
    n = (math.log(m(low)) - math.log(m(high))) / (math.log(t(low)) - math.log(t(high)))
    scale = LAMBERT["semi_major"] * m(low) / (n * t(low) ** n)
    rho0 = scale * t(math.radians(LAMBERT["origin_lat"])) ** n
    return {"ecc": ecc, "n": n, "scale": scale, "rho0": rho0}


LAMBERT_CONE = _lambert_parameters()


def lambert_xy(lat: str, lon: str) -> tuple[str, str]:
    """Easting and northing in metres (EPSG:3347) of a latitude and longitude in degrees."""
    ecc, n, scale, rho0 = (f"{LAMBERT_CONE[k]!r}D" for k in ("ecc", "n", "scale", "rho0"))
    s = f"{ecc} * sin(radians({lat}))"
    t = f"tan(pi() / 4 - radians({lat}) / 2) / power((1 - {s}) / (1 + {s}), {ecc} / 2)"
    rho = f"{scale} * power({t}, {n})"
    theta = f"{n} * radians({lon} - ({LAMBERT['origin_lon']!r}D))"
    east = f"{LAMBERT['false_easting']}D + {rho} * sin({theta})"
    north = f"{LAMBERT['false_northing']}D + {rho0} - {rho} * cos({theta})"
    return east, north


def distance(dx: str, dy: str) -> str:
    """Straight-line distance in the projected plane."""
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def inside_buffer(dx: str, dy: str, radius: float, mode: str = "circle") -> str:
    """Whether an offset lies strictly inside a buffer of ``radius``.

    ``circle`` is the true disc; ``polygon64`` the 64-sided polygon with corners on it.
    """
    if mode == "circle":
        return f"{distance(dx, dy)} < {float(radius)}D"
    if mode != "polygon64":
        raise ValueError(f"unknown buffer mode {mode!r}")
    angle = f"pmod(atan2({dy}, {dx}), pi() / 32) - pi() / 64"
    return f"{distance(dx, dy)} * cos({angle}) < {float(radius)}D * cos(pi() / 64)"


def province(lat: str, lon: str) -> str:
    """Code of the first province box, in priority order, that holds the point."""
    boxes = ((code, PROVINCE_BOXES[code]) for code in PROVINCE_PRIORITY)
    arms = [
        f"WHEN {lat} BETWEEN {min_lat}D AND {max_lat}D AND {lon} BETWEEN {min_lon}D AND {max_lon}D THEN '{code}'"
        for code, (min_lat, min_lon, max_lat, max_lon) in boxes
    ]
    return f"CASE {' '.join(arms)} ELSE 'Unknown' END"


CURVE_BITS = 16


def curve_key(lat: str, lon: str) -> str:
    """Place of a position along a Z-order curve over the globe: close keys are close places.

    Latitude and longitude are cut into ``2 ** CURVE_BITS`` steps and their bits interleaved.
    """
    def steps(value: str, low: int, span: int) -> str:
        most = (1 << CURVE_BITS) - 1
        return f"cast(least(greatest(floor(({value} - ({low})) / {span} * {most + 1}), 0), {most}) AS bigint)"

    def spread(bits: str) -> str:
        # Each step halves the runs of bits and doubles the gaps between them.
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = f"get(transform(array({bits}), b -> (b | shiftleft(b, {shift})) & {mask}L), 0)"
        return bits

    return f"{spread(steps(lon, -180, 360))} | shiftleft({spread(steps(lat, -90, 180))}, 1)"
