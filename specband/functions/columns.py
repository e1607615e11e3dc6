"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PIXEL = ["scan_id", "y", "x"]
BAND = ["excitation", "em_idx"]


def emission_axis(excitation: Column, em_idx: Column) -> Column:
    """Start at 420 nm up to an excitation of 400 nm, else 20 nm above it; step 10 nm."""
    return (F.when(excitation <= 400, F.lit(420.0)).otherwise(excitation + 20) + em_idx * 10).cast("double")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num / den, or ``empty`` when den is 0."""
    return F.when(den == 0, F.lit(empty)).otherwise(num / F.nullif(den, F.lit(0)))


def color_key(*cols: str) -> Column:
    return F.struct(*[F.col(c) for c in (cols or ("r", "g", "b", "a"))])


def in_polygon(y: Column, x: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a drawn polygon of (x, y) vertices (at least three)."""
    if len(points) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
        if ya == yb:
            continue
        spans = (F.lit(float(ya)) > y) != (F.lit(float(yb)) > y)
        at = (y - float(ya)) * ((xb - xa) / (yb - ya)) + float(xa)
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def hash_order_key(key: str, seed: int = 42) -> Column:
    """Reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]
