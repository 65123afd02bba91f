"""Derived meteorology and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.config import EARTH_RADIUS_KM


def saturation_vapour_pressure(t: Column) -> Column:
    """kPa over water at ``t`` degrees Celsius."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_pressure_deficit(t: Column, humidity: Column) -> Column:
    """kPa; humidity in per cent."""
    return saturation_vapour_pressure(t) * (1 - humidity / 100)


def bowen_ratio(sensible: Column, latent: Column) -> Column:
    """Null where the latent heat is zero."""
    return F.try_divide(sensible, latent)


def _half_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)


def haversine_atan(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km, by the two-argument arc tangent."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_asin(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The same by the arc sine."""
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lon1, lat1, lon2, lat2))))
