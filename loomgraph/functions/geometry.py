"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed floors of degenerate denominators.
SEGMENT_FLOOR = 1e-12


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c: positive when c lies left of a -> b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether a-b and c-d cross; an end on the other's line counts as not left of it."""
    left = lambda *p: turn(*p) > 0
    return (left(ax, ay, bx, by, cx, cy) != left(ax, ay, bx, by, dx, dy)) & (left(cx, cy, dx, dy, ax, ay) != left(cx, cy, dx, dy, bx, by))


def crossing_angle(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Degrees between the lines of a-b and c-d, 0 to 90."""
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    cosine = F.abs(ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy) + SEGMENT_FLOOR)
    return F.degrees(F.acos(F.least(cosine, F.lit(1.0))))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    ux, uy = bx - ax, by - ay
    t = ((px - ax) * ux + (py - ay) * uy) / F.greatest(ux * ux + uy * uy, F.lit(SEGMENT_FLOOR))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, ax + t * ux, ay + t * uy)


def ray_segment_distance(px, py, dx, dy, ax, ay, bx, by) -> Column:
    """How far along the direction the ray meets the segment; null where it doesn't."""
    ux, uy = bx - ax, by - ay
    cross = dx * uy - dy * ux
    t = ((ax - px) * uy - (ay - py) * ux) / cross
    s = ((ax - px) * dy - (ay - py) * dx) / cross
    return F.when((F.abs(cross) > SEGMENT_FLOOR) & (t > 1e-9) & (s >= 0) & (s <= 1), t)


def sector(dx: Column, dy: Column, n: int) -> Column:
    """Which of n equal sectors a direction lies in, counted from -pi."""
    width = 2 * 3.141592653589793 / n
    return F.least(F.floor((F.atan2(dy, dx) + F.pi()) / F.lit(width)), F.lit(n - 1)).cast("int")
