"""Distances and directions on the sphere, as column expressions (degrees in, kilometres out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any argument is."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    # greatest and least pass over nulls, so a null is kept by hand
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def signed_haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance with its sign turned once for a step south and once more for a step west."""
    turn = F.when(lat2 < lat1, -1).otherwise(1) * F.when(lon2 < lon1, -1).otherwise(1)
    return haversine_km(lat1, lon1, lat2, lon2) * turn


def displacement_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, legacy_axis_order: bool = False) -> tuple[Column, Column]:
    """(east, north) parts of a step, signed. ``legacy_axis_order`` hands longitudes over as latitudes."""
    if legacy_axis_order:
        east, north = haversine_km(lon1, lat1, lon2, lat1), haversine_km(lon1, lat1, lon1, lat2)
    else:
        east, north = haversine_km(lat1, lon1, lat1, lon2), haversine_km(lat1, lon1, lat2, lon1)
    return F.signum(lon2 - lon1) * east, F.signum(lat2 - lat1) * north


def heading(dx: Column, dy: Column, legacy: bool = False) -> tuple[Column, Column]:
    """Unit vector of a step, null for none; ``legacy`` gives cos and sin of atan(dx/dy)."""
    angle = F.atan(F.try_divide(dx, dy)) if legacy else F.atan2(dy, dx)
    moved = (dx != 0) | (dy != 0)
    return F.when(moved, F.cos(angle)), F.when(moved, F.sin(angle))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float], strict: bool = True) -> Column:
    """Whether a point lies in (lon0, lon1, lat0, lat1); a strict box has no boundary."""
    lon0, lon1, lat0, lat1 = box
    if strict:
        return (lon > lon0) & (lon < lon1) & (lat > lat0) & (lat < lat1)
    return lon.between(lon0, lon1) & lat.between(lat0, lat1)


def in_polygon(lon: Column, lat: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a polygon given by (lon, lat) vertices."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y0 == y1:
            continue
        spans = (F.lit(y0) > lat) != (F.lit(y1) > lat)
        crossings = crossings + F.when(spans & (lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0), 1).otherwise(0)
    return crossings % 2 == 1


def on_polygon(lon: Column, lat: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point lies on an edge or vertex of a polygon given by (lon, lat) vertices."""
    met = F.lit(False)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        extent = lon.between(min(x0, x1), max(x0, x1)) & lat.between(min(y0, y1), max(y0, y1))
        met = met | (extent & ((x1 - x0) * (lat - y0) == (y1 - y0) * (lon - x0)))
    return met


def segment_meets_box(lon1: Column, lat1: Column, lon2: Column, lat2: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether the straight segment between two points shares a point with a closed box."""
    lon0, lon_1, lat0, lat_1 = box
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for start, end, lo, hi in ((lon1, lon2, lon0, lon_1), (lat1, lat2, lat0, lat_1)):
        d = end - start
        outside = outside | ((d == 0) & ((start < lo) | (start > hi)))
        a, b = F.try_divide(lo - start, d), F.try_divide(hi - start, d)
        low = F.greatest(low, F.when(d != 0, F.least(a, b)).otherwise(0.0))
        high = F.least(high, F.when(d != 0, F.greatest(a, b)).otherwise(1.0))
    return ~outside & (low <= high)


def nearest_on_leg(lon1: Column, lat1: Column, lon2: Column, lat2: Column, site: tuple[float, float]) -> tuple[Column, Column]:
    """(lon, lat) of the point of a leg that is nearest to a site, in planar degrees."""
    dx, dy = lon2 - lon1, lat2 - lat1
    t = F.try_divide((site[0] - lon1) * dx + (site[1] - lat1) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return lon1 + t * dx, lat1 + t * dy


def degrees_minutes(text: Column) -> Column:
    """Signed degrees of texts as 14º29.352'S; null where the text is another."""
    pattern = r"^\s*(\d+)º(\d+(?:\.\d+)?)'?([NSEW])\s*$"
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    value = part[0].try_cast("double") + part[1].try_cast("double") / 60
    return F.when(part[2].isin("S", "W"), -value).otherwise(value)
