"""Rectangles as structs ``x0, y0, x1, y1`` and the tests between two of them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def shared_x(a: Column, b: Column) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def shared_y(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def overlaps(a: Column, b: Column, tol: float = 2.0) -> Column:
    """More than ``tol`` points shared in both directions."""
    return (shared_x(a, b) > tol) & (shared_y(a, b) > tol)


def covers(a: Column, b: Column, tol: float = 2.0) -> Column:
    """On the same line: more than ``tol`` across and more than half of the lower box's height down."""
    low = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (shared_x(a, b) > tol) & (shared_y(a, b) > F.greatest(F.lit(tol), low / 2))


def x_overlap_share(a: Column, b: Column) -> Column:
    """How much of the narrower of two widths is shared."""
    narrow = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return shared_x(a, b) / F.greatest(F.lit(1e-6), narrow.cast("double"))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_all(boxes: Column) -> Column:
    def low(f):
        return F.array_min(F.transform(boxes, lambda b: b[f]))

    def high(f):
        return F.array_max(F.transform(boxes, lambda b: b[f]))
    return box(low("x0"), low("y0"), high("x1"), high("y1"))


def squared_gap(a: Column, b: Column) -> Column:
    """The squared distance between two boxes, 0 when they touch."""
    dx = F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"])
    dy = F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])
    return dx * dx + dy * dy
