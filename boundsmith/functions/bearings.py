"""Bearings, azimuths and directions as column expressions (degrees, 0 = north, clockwise)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Azimuth of each direction word, besides the -ERLY forms.
_POINTS = {"NORTH": 0.0, "NORTHEAST": 45.0, "EAST": 90.0, "SOUTHEAST": 135.0, "SOUTH": 180.0, "SOUTHWEST": 225.0, "WEST": 270.0, "NORTHWEST": 315.0}
WORD_AZIMUTH = {w + tail: a for w, a in _POINTS.items() for tail in ("", "ERLY")}


def lookup(key: Column, table: dict) -> Column:
    """A small fixed table as a map literal; unknown keys give null."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*entries), key)


def word_azimuth(word: Column) -> Column:
    return lookup(F.upper(word), WORD_AZIMUTH)


def dms(deg: Column, minute: Column, sec: Column) -> Column:
    return deg.cast("double") + minute.cast("double") / 60.0 + sec.cast("double") / 3600.0


def normalize_azimuth(az: Column) -> Column:
    """Into [0, 360); values within 1e-12 of a full turn become 0."""
    turned = F.pmod(az, F.lit(360.0))
    return F.when(F.abs(turned - 360.0) < 1e-12, 0.0).otherwise(turned)


def quadrant_azimuth(ns: Column, ew: Column, theta: Column) -> Column:
    """Without a range check: N 180 E is 180, N 0 W is 360."""
    north, east = F.upper(ns) == "N", F.upper(ew) == "E"
    return F.when(north & east, theta).when(~north & east, 180.0 - theta).when(~north & ~east, 180.0 + theta).otherwise(360.0 - theta)


def strict_azimuth(ns: Column, ew: Column, theta: Column) -> Column:
    """Null (BAD_BEARING_FORMAT) if the angle isn't within [0, 90]; else in [0, 360)."""
    return F.when(theta.between(0.0, 90.0), normalize_azimuth(quadrant_azimuth(ns, ew, theta)))


def rotated(az: Column, rotation: Column) -> Column:
    return normalize_azimuth(az + rotation)


def bearing_azimuth(ns: Column, ew: Column, theta: Column, basis: Column, target: str, rotation: Column) -> Column:
    """Struct ``azimuth, error``: another basis needs an explicit rotation."""
    az = strict_azimuth(ns, ew, theta)
    differs = basis != target
    error = (
        F.when(ns.isNull() | ew.isNull() | theta.isNull(), "BAD_BEARING_FORMAT").when(az.isNull(), "BAD_BEARING_FORMAT")
        .when(differs & rotation.isNull(), "BASIS_ROTATION_REQUIRED")
    )
    return F.struct(F.when(error.isNull(), F.when(differs, rotated(az, rotation)).otherwise(az)).alias("azimuth"), error.alias("error"))


def offsets(az: Column, dist: Column) -> tuple[Column, Column]:
    return dist * F.sin(F.radians(az)), dist * F.cos(F.radians(az))


def angular_diff(a: Column, b: Column) -> Column:
    """Folded to [0, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def azimuth_of(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def to_quadrant(az: Column) -> Column:
    """Struct ``ns, deg, minute, sec, ew``; degrees and minutes truncate."""
    ns = F.when((az <= 90) | (az >= 270), "N").otherwise("S")
    ew = F.when(az <= 180, "E").otherwise("W")
    theta = F.when(az <= 90, az).when(az <= 180, 180 - az).when(az <= 270, az - 180).otherwise(360 - az)
    deg = F.floor(theta).cast("int")
    minute = F.floor((theta - deg) * 60).cast("int")
    sec = ((theta - deg) * 60 - minute) * 60
    return F.struct(ns.alias("ns"), deg.alias("deg"), minute.alias("minute"), sec.alias("sec"), ew.alias("ew"))


def concave_side(feature: Column, incoming: Column) -> Column:
    """``right``/``left`` of a ``CONCAVE <direction>`` label; null if collinear or unknown."""
    word = F.regexp_extract(F.upper(F.trim(feature)), r"^CONCAVE\s+(\S+)$", 1)
    diff = F.pmod(word_azimuth(word) - incoming, F.lit(360.0))
    level = (diff < 1e-9) | (F.abs(diff - 180.0) < 1e-9) | (F.abs(diff - 360.0) < 1e-9)
    return F.when(~level & (diff < 180.0), "right").when(~level, "left")


def derived_delta(delta_deg: Column, arc: Column, chord: Column, radius: Column) -> Column:
    """Central angle in radians from the angle, the arc or the chord; null if none does."""
    half = F.try_divide(chord, 2 * radius)
    return F.coalesce(F.radians(delta_deg), F.try_divide(arc, radius), F.when(half.between(0.0, 1.0), 2 * F.asin(half)))


def azimuth_value(deg: Column, minute: Column, sec: Column) -> Column:
    """Struct ``azimuth, error`` of an azimuth in parts; 360 is 0."""
    az = dms(deg, minute, sec)
    bad = az.isNull() | (az < 0) | (az > 360)
    return F.struct(F.when(~bad, normalize_azimuth(az)).alias("azimuth"), F.when(bad, "BAD_BEARING_FORMAT").alias("error"))


def half_turn(theta: Column) -> Column:
    """Radians into [-pi, pi)."""
    return F.pmod(theta + math.pi, F.lit(TWO_PI)) - math.pi


def line_end(x: Column, y: Column, az: Column, dist: Column) -> Column:
    """Struct ``x, y, error``: the end of a line, whose distance must be positive."""
    dx, dy = offsets(az, dist)
    good = dist > 0
    return F.struct(F.when(good, x + dx).alias("x"), F.when(good, y + dy).alias("y"), F.when(~F.coalesce(good, F.lit(False)), "Distance must be positive for line computation").alias("error"))


def curve_outcome(curve_type: Column, incoming: Column, radius: Column, handedness: Column, delta: Column, arc: Column, chord: Column, anchored: Column) -> Column:
    """Struct ``delta, error``: the central angle in radians, or why a curve can't be computed.

    A tangent curve needs the azimuth it comes in by; every curve a radius, a side and
    something that gives the angle (``delta`` in degrees), and one that isn't tangent an anchor.
    """
    incomplete, ratio = F.lit("CURVE_INCOMPLETE"), F.try_divide(chord, 2 * radius)
    angle_error = (
        F.when(delta.isNotNull(), F.when(delta <= 0, incomplete))
        .when(arc.isNotNull(), F.when((arc <= 0) | (radius <= 0), incomplete))
        .when(chord.isNotNull(), F.when((chord <= 0) | (radius <= 0), incomplete).when(ratio > 1, "CURVE_PARAM_MISMATCH"))
        .otherwise(incomplete)
    )
    error = (
        F.when(~curve_type.isin("tangent", "non_tangent"), "UNKNOWN_ELEMENT")
        .when((curve_type == "tangent") & incoming.isNull(), "NEEDS_REFERENCE_GEOMETRY")
        .when(radius.isNull() | (radius <= 0) | handedness.isNull(), incomplete).when(angle_error.isNotNull(), angle_error)
        .when((curve_type == "non_tangent") & ~F.coalesce(anchored, F.lit(False)), "NON_TANGENT_AMBIGUITY")
    )
    return F.struct(F.when(error.isNull(), derived_delta(delta, arc, chord, radius)).alias("delta"), error.alias("error"))


TWO_PI = 2 * math.pi
