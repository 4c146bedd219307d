"""Geospatial column expressions (P17, P18, F3, F4, J4 distance)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# City centre, metro bounding box, low-confidence snap distance.
CITY_CENTER = (12.9716, 77.5946)
LAT_RANGE = (12.7, 13.3)
LON_RANGE = (77.3, 77.9)
MAX_SNAP_DISTANCE_M = 750.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dist_from_center(lat="latitude", lon="longitude", center=CITY_CENTER) -> Column:
    """Euclidean distance in degrees from the fixed centre."""
    dlat = _c(lat) - F.lit(center[0])
    dlon = _c(lon) - F.lit(center[1])
    return F.sqrt(dlat * dlat + dlon * dlon)


def missing_coords(lat="latitude", lon="longitude") -> Column:
    """F3."""
    return _c(lat).isNull() | _c(lon).isNull()


def outside_bbox(lat="latitude", lon="longitude", lat_range=LAT_RANGE, lon_range=LON_RANGE) -> Column:
    """flag (not filter) coordinates outside the box; NULL coords are not flagged."""
    inside = _c(lat).between(*lat_range) & _c(lon).between(*lon_range)
    return F.coalesce(~inside & _c(lat).isNotNull() & _c(lon).isNotNull(), F.lit(False))


def low_confidence(dist, limit: float = MAX_SNAP_DISTANCE_M) -> Column:
    """Distance above the limit; NULL distance -> false."""
    return F.coalesce(_c(dist) > F.lit(limit), F.lit(False))


# ----------------------------------------------------------- P18 projection
# WGS84 ellipsoid and UTM constants (fixed values).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0


def utm_zone_central_meridian(zone: int) -> float:
    return -183.0 + 6.0 * zone


def _kruger_coeffs():
    """Krueger series coefficients (6th order in the third flattening n)."""
    f = WGS84_F
    n = f / (2 - f)
    n2, n3, n4, n5, n6 = n ** 2, n ** 3, n ** 4, n ** 5, n ** 6
    A = WGS84_A / (1 + n) * (1 + n2 / 4 + n4 / 64 + n6 / 256)
    alpha = [
        n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180 - 127 * n5 / 288 + 7891 * n6 / 37800,
        13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440 + 281 * n5 / 630 - 1983433 * n6 / 1935360,
        61 * n3 / 240 - 103 * n4 / 140 + 15061 * n5 / 26880 + 167603 * n6 / 181440,
        49561 * n4 / 161280 - 179 * n5 / 168 + 6601661 * n6 / 7257600,
        34729 * n5 / 80640 - 3418889 * n6 / 1995840,
        212378941 * n6 / 319334400,
    ]
    e = math.sqrt(f * (2 - f))
    return A, alpha, e


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utm_project(lat="latitude", lon="longitude", zone: int = 43) -> tuple[Column, Column]:
    """Geographic degrees -> UTM easting/northing metres (northern zone).

    Pure column arithmetic (no UDF). Intermediate values are bound once: written
    out, the series repeats them so often that its code is too long to compile.
    ``atanh``/``sinh``/``cosh`` are written through ``log``/``exp`` so the SQL
    oracle can evaluate the identical formula.
    """
    A, alpha, e = _kruger_coeffs()
    lam0 = math.radians(utm_zone_central_meridian(zone))
    phi = F.radians(_c(lat))
    lam = F.radians(_c(lon)) - F.lit(lam0)
    s = F.sin(phi)

    def atanh(x):
        return _let(x, lambda v: F.lit(0.5) * F.log((F.lit(1.0) + v) / (F.lit(1.0) - v)))

    t = _let(s, lambda s: F.exp(atanh(s) - F.lit(e) * atanh(F.lit(e) * s)))
    t = _let(t, lambda t: (t - F.lit(1.0) / t) / F.lit(2.0))  # sinh(.)
    both = _let(t, lambda t: F.struct(F.atan2(t, F.cos(lam)).alias("xi"), atanh(F.sin(lam) / F.sqrt(t * t + F.lit(1.0))).alias("eta")))

    def summed(part: str, xi_p: Column, eta_p: Column) -> Column:
        total = xi_p if part == "xi" else eta_p
        for j, a in enumerate(alpha, start=1):
            two_j = F.lit(float(2 * j))
            e_pos, e_neg = F.exp(two_j * eta_p), F.exp(F.lit(float(-2 * j)) * eta_p)
            if part == "xi":
                total = total + F.lit(a) * F.sin(two_j * xi_p) * ((e_pos + e_neg) / F.lit(2.0))
            else:
                total = total + F.lit(a) * F.cos(two_j * xi_p) * ((e_pos - e_neg) / F.lit(2.0))
        return total

    easting = F.lit(UTM_FALSE_EASTING) + F.lit(UTM_K0 * A) * _let(both, lambda p: summed("eta", p["xi"], p["eta"]))
    northing = F.lit(UTM_K0 * A) * _let(both, lambda p: summed("xi", p["xi"], p["eta"]))
    return easting, northing


def utm_project_sql(lat: str = "latitude", lon: str = "longitude", zone: int = 43) -> tuple[str, str]:
    """The same series as SQL text (DuckDB), for the oracle."""
    A, alpha, e = _kruger_coeffs()
    lam0 = math.radians(utm_zone_central_meridian(zone))

    def lit(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    phi = f"radians({lat})"
    lam = f"(radians({lon}) - {lit(lam0)})"
    s = f"sin({phi})"

    def atanh(x):
        return f"(0.5e0 * ln((1.0e0 + {x}) / (1.0e0 - {x})))"

    t0 = f"exp({atanh(s)} - {lit(e)} * {atanh(f'{lit(e)} * {s}')})"
    t = f"(({t0}) - 1.0e0 / ({t0})) / 2.0e0"
    xi_p = f"atan2({t}, cos({lam}))"
    ch = f"sqrt(({t}) * ({t}) + 1.0e0)"
    eta_p = atanh(f"sin({lam}) / {ch}")
    xi, eta = xi_p, eta_p
    for j, a in enumerate(alpha, start=1):
        two_j = float(2 * j)
        e_pos = f"exp({lit(two_j)} * {eta_p})"
        e_neg = f"exp({lit(-two_j)} * {eta_p})"
        cosh_ = f"(({e_pos} + {e_neg}) / 2.0e0)"
        sinh_ = f"(({e_pos} - {e_neg}) / 2.0e0)"
        xi = f"({xi} + {lit(a)} * sin({lit(two_j)} * {xi_p}) * {cosh_})"
        eta = f"({eta} + {lit(a)} * cos({lit(two_j)} * {xi_p}) * {sinh_})"
    return f"({lit(UTM_FALSE_EASTING)} + {lit(UTM_K0 * A)} * {eta})", f"({lit(UTM_K0 * A)} * {xi})"


# ------------------------------------------------------ point-segment distance
def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Euclidean distance from P to segment AB.

    Vertex cases use the vertex itself (not ``A + t(B-A)``) so a point nearest
    to a shared vertex gets bit-identical distances from both segments and
    ties break on edge ids, not on rounding noise.
    """
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / len2
    da = F.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))
    db = F.sqrt((px - bx) * (px - bx) + (py - by) * (py - by))
    cx, cy = ax + t * dx, ay + t * dy
    dm = F.sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy))
    return (F.when(len2 == 0, da).when(t <= 0, da).when(t >= 1, db).otherwise(dm))


def point_segment_distance_sql(px, py, ax, ay, bx, by) -> str:
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"((({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {len2})"
    da = f"sqrt(({px} - {ax}) * ({px} - {ax}) + ({py} - {ay}) * ({py} - {ay}))"
    db = f"sqrt(({px} - {bx}) * ({px} - {bx}) + ({py} - {by}) * ({py} - {by}))"
    cx, cy = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
    dm = f"sqrt(({px} - {cx}) * ({px} - {cx}) + ({py} - {cy}) * ({py} - {cy}))"
    return (f"CASE WHEN {len2} = 0 THEN {da} WHEN {t} <= 0 THEN {da} "
            f"WHEN {t} >= 1 THEN {db} ELSE {dm} END")
