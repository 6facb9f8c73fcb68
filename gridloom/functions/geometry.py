"""Geometric predicates as Column expressions. Coordinates are whole numbers, cross products are exact BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Twice the signed area of p, q, r."""
    wide = lambda c: c.cast("long")
    return (wide(qx) - wide(px)) * (wide(ry) - wide(py)) - (wide(qy) - wide(py)) * (wide(rx) - wide(px))


def in_triangle(x: Column, y: Column, t: str = "") -> Column:
    """Whether (x, y) lies in the triangle ``ax, ay, bx, by, cx, cy``, its border included, for either winding."""
    c = lambda name: F.col(t + name)
    d = [cross(c(p + "x"), c(p + "y"), c(q + "x"), c(q + "y"), x, y) for p, q in ("ab", "bc", "ca")]
    below = (d[0] < 0) | (d[1] < 0) | (d[2] < 0)
    above = (d[0] > 0) | (d[1] > 0) | (d[2] > 0)
    return ~(below & above)


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax.cast("long") - bx, ay.cast("long") - by
    return dx * dx + dy * dy


def inside_circumsphere(x: Column, y: Column, t: Column) -> Column:
    """Whether the point (x, y, t) is nearer to the circumcentre of ``ax .. cy`` at t = 0 than its vertices.

    For collinear vertices the centre is the centroid and the radius reaches the farthest vertex. The order
    of the floating-point operations is fixed, as points on the border decide by the last bit.
    """
    ax, ay, bx, by, cx, cy = (F.col(n).cast("double") for n in ("ax", "ay", "bx", "by", "cx", "cy"))
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    n = ux * vy - uy * vx
    u2, v2 = ux * ux + uy * uy, vx * vx + vy * vy
    den = F.lit(2.0) * (n * n)
    flat = n * n < 1e-12
    ox = F.when(flat, (ax + bx + cx) / 3.0).otherwise(ax + (v2 * (-(n * uy)) + u2 * (vy * n)) / F.when(flat, 1.0).otherwise(den))
    oy = F.when(flat, (ay + by + cy) / 3.0).otherwise(ay + (v2 * (n * ux) + u2 * (-(vx * n))) / F.when(flat, 1.0).otherwise(den))
    reach = F.greatest(*((px - ox) * (px - ox) + (py - oy) * (py - oy) for px, py in ((ax, ay), (bx, by), (cx, cy))))
    dx, dy = x.cast("double") - ox, y.cast("double") - oy
    return F.sqrt(dx * dx + dy * dy + t * t) < F.sqrt(reach)
