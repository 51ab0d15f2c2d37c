"""Geometry on the sphere as Column expressions; all angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Value, col, finite

FULL_SKY_DEG2 = 4 * math.pi * (180 / math.pi) ** 2
SENTINEL_FLOOR = -9000.0


def wrap_ra(ra: Value) -> Column:
    """RA reduced to [0, 360)."""
    r = F.pmod(col(ra).cast("double"), F.lit(360.0))
    return F.when((r >= 360.0) & ~F.isnan(r), 0.0).otherwise(r)


def separation(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    """Haversine form: well conditioned at arc seconds."""
    a1, d1, a2, d2 = (F.radians(col(x).cast("double")) for x in (ra1, dec1, ra2, dec2))
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin((a2 - a1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def _cosine(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    a1, d1, a2, d2 = (F.radians(col(x).cast("double")) for x in (ra1, dec1, ra2, dec2))
    return F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(a1 - a2)


def separation_acos(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    """Arc cosine form of the cone search; clamped above only."""
    return F.degrees(F.acos(F.least(F.lit(1.0), _cosine(ra1, dec1, ra2, dec2))))


def separation_dot(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    """Dot product of unit vectors, clamped on both sides."""
    a1, d1, a2, d2 = (F.radians(col(x).cast("double")) for x in (ra1, dec1, ra2, dec2))
    dot = F.cos(d1) * F.cos(a1) * F.cos(d2) * F.cos(a2) + F.cos(d1) * F.sin(a1) * F.cos(d2) * F.sin(a2) + F.sin(d1) * F.sin(d2)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def arcsec(separation_deg: Value) -> Column:
    return col(separation_deg) * 3600.0


def valid_sky(ra: Value, dec: Value) -> Column:
    """Finite, |dec| at most 90, neither a sentinel; the range of RA isn't checked."""
    r, d = col(ra).cast("double"), col(dec).cast("double")
    return finite(r) & finite(d) & d.between(-90, 90) & (r > SENTINEL_FLOOR) & (d > SENTINEL_FLOOR)


def in_bbox(ra: Value, dec: Value, ra_min: float, ra_max: float, dec_min: float, dec_max: float) -> Column:
    """Bounds inclusive; ra_min > ra_max wraps through 0."""
    r = col(ra)
    across = (r >= ra_min) | (r <= ra_max) if ra_min > ra_max else r.between(ra_min, ra_max)
    return across & col(dec).between(dec_min, dec_max)


def tile_area_deg2(order: int) -> float:
    return FULL_SKY_DEG2 / (12 * 4**order)


def files_per_tile(files: int, order: int, sky_deg2: float = FULL_SKY_DEG2) -> float:
    """Files that overlap a tile on average when ``files`` cover ``sky_deg2``."""
    return files * tile_area_deg2(order) / sky_deg2


def sexagesimal(text: Value, hours: bool = False) -> Column:
    """'[+-]d m s' (blanks or colons between) in degrees; null if it isn't of that form."""
    t = F.trim(col(text))
    pattern = r"^([+-]?)(\d+)[ :]+(\d+)[ :]+(\d+(?:\.\d*)?)$"
    part = lambda k: F.expr("1").cast("double") * F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("double")
    size = part(2) + part(3) / 60 + part(4) / 3600
    sign = F.when(F.regexp_extract(t, pattern, 1) == "-", -1.0).otherwise(1.0)
    return sign * size * (15.0 if hours else 1.0)
