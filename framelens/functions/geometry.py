"""Eye, head-pose and iris geometry as column expressions over landmark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from framelens.config import MAX_REPROJECTION_PX, POSE_LIMITS, SUSPICIOUS_YAW


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def min_eye_width(image_width: Column) -> Column:
    """At least 2 px and 0.5 % of the image width."""
    return F.greatest(F.lit(2.0), image_width * F.lit(0.005))


def eye_aspect_ratio(points: list[Column], min_px: Column) -> Column:
    """Lid openings over twice the eye width; null for a degenerate eye."""
    p1, p2, p3, p4, p5, p6 = points
    width = distance(p1, p4)
    return F.when(width >= min_px, (distance(p2, p6) + distance(p3, p5)) / (width * 2.0))


def average_ear(left: Column, right: Column) -> Column:
    """Mean of both eyes, null unless both are valid."""
    return (left + right) / 2.0


def euler_angles(r: list[list[Column]]) -> dict[str, Column]:
    """Pitch, yaw and roll in degrees of a 3x3 rotation matrix."""
    sy = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    singular = sy < F.lit(1e-6)
    return {
        "pitch": F.degrees(F.when(singular, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))),
        "yaw": F.degrees(F.atan2(-r[2][0], sy)),
        "roll": F.degrees(F.when(singular, F.lit(0.0)).otherwise(F.atan2(r[1][0], r[0][0]))),
    }


def wrap_degrees(angle: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(angle + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def normalize_angles(pitch: Column, yaw: Column, roll: Column) -> dict[str, Column]:
    """Equivalent angles with pitch folded into [-90, 90]."""
    p, y, r = wrap_degrees(pitch), wrap_degrees(yaw), wrap_degrees(roll)
    folded = F.abs(p) > 90.0
    turn = lambda a: F.when(folded, wrap_degrees(a + F.lit(180.0))).otherwise(a)
    return {"pitch": wrap_degrees(F.when(folded, F.signum(p) * F.lit(180.0) - p).otherwise(p)),
            "yaw": wrap_degrees(turn(y)), "roll": wrap_degrees(turn(r))}


def pose_valid(pitch: Column, yaw: Column, roll: Column, error_px: Column) -> Column:
    inside = [F.abs(a) <= POSE_LIMITS[n] for n, a in (("pitch", pitch), ("yaw", yaw), ("roll", roll))]
    return F.coalesce((inside[0] & inside[1] & inside[2] & (error_px <= MAX_REPROJECTION_PX)).cast("int"), F.lit(0))


def ear_suspicious(ear_valid: Column, yaw: Column) -> Column:
    odd = yaw.isNull() | (F.abs(yaw) > SUSPICIOUS_YAW)
    return F.when((ear_valid == 1) & odd, 1).otherwise(0)


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_center(points: Column) -> Column:
    """Mean point of an array of points."""
    n = F.size(points).cast("double")
    total = lambda axis: F.aggregate(points.getField(axis), F.lit(0.0), lambda a, b: a + b)
    return _xy(total("x") / n, total("y") / n)


def midpoint(a: Column, b: Column) -> Column:
    return _xy((a["x"] + b["x"]) / 2.0, (a["y"] + b["y"]) / 2.0)


def iris_position(center: Column, points: list[Column]) -> Column:
    """Iris centre in eye coordinates: along the corner axis (x) and the lid axis (y); null for a degenerate eye."""
    p1, p2, p3, p4, p5, p6 = points
    ordered = p1["x"] <= p4["x"]
    left, right = F.when(ordered, p1).otherwise(p4), F.when(ordered, p4).otherwise(p1)
    upper, lower = midpoint(p2, p3), midpoint(p5, p6)
    hx, hy = right["x"] - left["x"], right["y"] - left["y"]
    vx, vy = lower["x"] - upper["x"], lower["y"] - upper["y"]
    hh, vv = hx * hx + hy * hy, vx * vx + vy * vy
    x = ((center["x"] - left["x"]) * hx + (center["y"] - left["y"]) * hy) / hh
    y = ((center["x"] - upper["x"]) * vx + (center["y"] - upper["y"]) * vy) / vv
    return F.when((hh >= 1e-6) & (vv >= 1e-6), _xy(x, y))


def combined_iris(left: Column, right: Column) -> Column:
    """Mean of both eyes, null unless both are valid."""
    return F.when(left.isNotNull() & right.isNotNull(), midpoint(left, right))


def stride_flag(frame: Column, stride: int, offset: int = 0) -> Column:
    """Keep frames with ``(frame - offset) % stride = 0``: offset 0 for gaze, 1 for frame features."""
    return (frame - offset) % stride == 0
