"""Geometry as Column arithmetic, so that it stays inside whole-stage code generation."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.constants import FOCUS_AREA

EARTH_KM = 6371.0

# WGS84 and the transverse Mercator grid
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_polygon(lon: Column | str, lat: Column | str, ring: list[tuple[float, float]] = FOCUS_AREA) -> Column:
    """Strictly inside a closed (lon, lat) ring; the boundary, nulls and NaN are outside.

    The bounding box comes first: on a stored table it reaches the scan as range filters.
    """
    x, y = _col(lon), _col(lat)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = (x > min(xs)) & (x < max(xs)) & (y > min(ys)) & (y < max(ys))
    crossings, on_edge = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings.append(spans & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1)))
        turn = F.lit(x2 - x1) * (y - F.lit(y1)) - F.lit(y2 - y1) * (x - F.lit(x1))
        on_edge.append((turn == 0.0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    odd = reduce(lambda a, b: a != b, crossings)
    # Only the exact part is guarded against nulls: a guard around the box would keep it from the scan.
    return box & F.coalesce(odd & ~reduce(lambda a, b: a | b, on_edge), F.lit(False))


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a1, o1, a2, o2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(a2 - a1) / 2.0)
    half_lon = F.sin(F.radians(o2 - o1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * half_lon * half_lon
    return F.lit(EARTH_KM) * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def krueger_series(flattening: float = FLATTENING) -> tuple[float, float, list[float]]:
    """Eccentricity, rectifying radius and forward coefficients, to the fourth order of the third flattening."""
    n = flattening / (2 - flattening)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return 2 * math.sqrt(n) / (1 + n), radius, alphas


def with_utm(df: DataFrame, lon: str = "Longitude", lat: str = "Latitude", zone: int = 33) -> DataFrame:
    """Adds Easting and Northing in metres on the northern half of a UTM zone.

    The angles are columns of their own, so that the series terms share them.
    """
    ecc, radius, alphas = krueger_series()
    sin_lat = F.sin(F.radians(lat))
    dlon = F.radians(F.col(lon) - F.lit(6.0 * zone - 183.0))
    conformal = df.withColumn("_t", F.sinh(F.atanh(sin_lat) - F.lit(ecc) * F.atanh(F.lit(ecc) * sin_lat)))
    xi, eta, t = F.col("_xi"), F.col("_eta"), F.col("_t")
    angles = conformal.withColumns({
        "_xi": F.atan2(t, F.cos(dlon)), "_eta": F.atanh(F.sin(dlon) / F.sqrt(1.0 + t * t))
    })
    east, north = eta, xi
    for j, alpha in enumerate(alphas, start=1):
        k = float(2 * j)
        east = east + F.lit(alpha) * F.cos(k * xi) * F.sinh(k * eta)
        north = north + F.lit(alpha) * F.sin(k * xi) * F.cosh(k * eta)
    scale = F.lit(SCALE * radius)
    return angles.withColumns({
        "Easting": F.lit(FALSE_EASTING) + scale * east, "Northing": scale * north
    }).drop("_t", "_xi", "_eta")
