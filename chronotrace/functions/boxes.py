"""Box arithmetic on (x, y, w, h) columns, clamping and labelled ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``c`` limited to [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union; 0 where the boxes do not meet."""
    zero = F.lit(0)
    iw = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = iw * ih
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def ladder(c: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """Label of the first step whose upper bound exceeds ``c``."""
    out = None
    for bound, label in steps:
        cond = c < F.lit(bound)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(top)
