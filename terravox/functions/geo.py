"""Spherical geometry as Column builders; all arguments in degrees, results in km or degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius of the sphere in km, and the floor under cos(latitude) for cell widths.
EARTH_KM = 6371.0
# Fixed value: kilometres in a degree, as the spacing of a sheet's limbs is given.
KM_PER_DEGREE_TABLE = 111.19
CELL_COS_FLOOR = 0.02
SEED_COS_FLOOR = 0.05


def wrap180(lon: Column) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def _clip1(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))


def arc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, arccos form."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))
    return EARTH_KM * F.acos(_clip1(cosine))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, haversine form: exact to well below 1 km for near points."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(_clip1(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, 0 to 360 clockwise from north."""
    a, b, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    return wrap360(F.degrees(F.atan2(east, north)))


def tangent_offsets(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north offsets in km in the equirectangular frame at (lat0, lon0)."""
    km = F.lit(EARTH_KM * 3.141592653589793 / 180.0)
    east = km * wrap180(lon - lon0) * F.cos(F.radians(lat0))
    return east, km * (lat - lat0)


def azimuthal_offsets(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north offsets preserving distance and bearing from the origin."""
    d = arc_km(lat0, lon0, lat, lon)
    b = F.radians(bearing_deg(lat0, lon0, lat, lon))
    return d * F.sin(b), d * F.cos(b)


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def earth_xyz(depth_km: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in km of a point at depth."""
    r = EARTH_KM - depth_km
    x, y, z = unit_xyz(lat, lon)
    return r * x, r * y, r * z


def along_cross_deg(az_deg: Column, north_deg: Column, east_deg: Column) -> tuple[Column, Column]:
    """Components of an offset along and across an azimuth."""
    a = F.radians(az_deg)
    along = north_deg * F.cos(a) + east_deg * F.sin(a)
    cross = east_deg * F.cos(a) - north_deg * F.sin(a)
    return along, cross


def cell_km(lat: Column, dlat_deg: float, dlon_deg: float) -> tuple[Column, Column]:
    """Height (a constant) and width of a grid cell in km."""
    km = EARTH_KM * 3.141592653589793 / 180.0
    width = F.lit(dlon_deg * km) * F.greatest(F.cos(F.radians(lat)), F.lit(CELL_COS_FLOOR))
    return F.lit(dlat_deg * km), width


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the disc of equal area; an absent shell has no width rather than width 0."""
    return F.when(area > 0, 2 * F.sqrt(area / 3.141592653589793))


def gaussian_falloff(distance: Column, radius: Column | float) -> Column:
    """Radial weight whose standard deviation is half the radius."""
    u = distance / (F.lit(radius) / 2)
    return F.exp(-u * u / 2)


def step_price(length: Column, anomaly: Column, s: Column | float) -> Column:
    return length * F.exp(F.lit(s) * anomaly)
