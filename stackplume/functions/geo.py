"""Great-circle geometry on latitude/longitude columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackplume.functions.numeric import column

EARTH_RADIUS_KM = 6371.0


def _arc_to_km(arc: Column) -> Column:
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(arc), F.sqrt(F.greatest(1 - arc, F.lit(0.0))))


def _squared_sine(angle: Column) -> Column:
    half = F.sin(angle / 2)
    return half * half


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance in km between two points."""
    a, b, c, d = (F.radians(column(x)) for x in (lat1, lon1, lat2, lon2))
    return _arc_to_km(_squared_sine(c - a) + F.cos(a) * F.cos(c) * _squared_sine(d - b))


def box_gap_km(lat, lon, min_lat, max_lat, min_lon, max_lon) -> Column:
    """A distance no point of the box can undercut, seen from (lat, lon).

    Latitude gap and longitude gap are each minimised on their own, and the smaller cosine of the box is used, so
    the result never exceeds the true distance.  Longitudes are compared around the circle.
    """
    p, q = column(lat), column(lon)
    south, north, west, east = (column(x) for x in (min_lat, max_lat, min_lon, max_lon))
    lat_gap = F.greatest(south - p, p - north, F.lit(0.0))
    outside = F.least(
        F.pmod(west - q, F.lit(360.0)),
        F.pmod(q - east, F.lit(360.0)),
    )
    lon_gap = F.when((q >= west) & (q <= east), F.lit(0.0)).otherwise(F.least(outside, F.lit(180.0)))
    narrow = F.least(F.cos(F.radians(south)), F.cos(F.radians(north)))
    arc = _squared_sine(F.radians(lat_gap)) + F.cos(F.radians(p)) * narrow * _squared_sine(F.radians(lon_gap))
    return _arc_to_km(F.least(arc, F.lit(1.0)))


def boxes_gap_km(a: dict, b: dict) -> Column:
    """A distance no pair of points, one from each box, can undercut."""
    lat_gap = F.greatest(a["min_lat"] - b["max_lat"], b["min_lat"] - a["max_lat"], F.lit(0.0))
    ahead = F.pmod(b["min_lon"] - a["max_lon"], F.lit(360.0))
    behind = F.pmod(a["min_lon"] - b["max_lon"], F.lit(360.0))
    overlap = (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"])
    lon_gap = F.when(overlap, F.lit(0.0)).otherwise(F.least(ahead, behind, F.lit(180.0)))
    narrow = F.least(*(F.cos(F.radians(x[edge])) for x in (a, b) for edge in ("min_lat", "max_lat")))
    arc = _squared_sine(F.radians(lat_gap)) + narrow * narrow * _squared_sine(F.radians(lon_gap))
    return _arc_to_km(F.least(arc, F.lit(1.0)))


def boxes_span_km(a: dict, b: dict) -> Column:
    """A distance no pair of points, one from each box, can exceed."""
    lat_span = F.greatest(F.abs(a["max_lat"] - b["min_lat"]), F.abs(b["max_lat"] - a["min_lat"]))
    lon_span = F.least(
        F.greatest(F.abs(a["max_lon"] - b["min_lon"]), F.abs(b["max_lon"] - a["min_lon"])), F.lit(180.0)
    )
    wide = []
    for box in (a, b):
        crosses = (box["min_lat"] <= 0) & (box["max_lat"] >= 0)
        edge = F.greatest(F.cos(F.radians(box["min_lat"])), F.cos(F.radians(box["max_lat"])))
        wide.append(F.when(crosses, F.lit(1.0)).otherwise(edge))
    arc = _squared_sine(F.radians(lat_span)) + wide[0] * wide[1] * _squared_sine(F.radians(lon_span))
    return _arc_to_km(F.least(arc, F.lit(1.0)))


def bounding_box(lat, lon, radius_km) -> dict[str, Column]:
    """Box around a centre that holds every point within the radius at that latitude (a cheap prefilter)."""
    p, q, r = column(lat), column(lon), column(radius_km)
    cosine = F.cos(F.radians(p))
    tiny = 1e-6
    cosine = F.when(F.abs(cosine) < tiny, F.when(cosine < 0, F.lit(-tiny)).otherwise(F.lit(tiny))).otherwise(cosine)
    d_lat = r / 111.0
    d_lon = r / (111.0 * cosine)
    return {"min_lat": p - d_lat, "max_lat": p + d_lat, "min_lon": q - d_lon, "max_lon": q + d_lon}
