"""Canonical inputs: every primitive kind is lowered to axis-aligned boxes with scalar DOUBLE columns.

``idx`` is the caller's id and need not be unique. Rows with a null, NaN or infinite coordinate are dropped, as they have no
place in space. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
LOW, HIGH = [f"min_{a}" for a in AXES], [f"max_{a}" for a in AXES]
BOX = [*LOW, *HIGH]

_KINDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_primitive(kind: str, lower: Callable[[DataFrame], DataFrame]) -> None:
    """Makes ``canonicalize(df, kind)`` lower a further kind: ``lower`` returns idx and the six bounds."""
    _KINDS[kind] = lower


def finite(*cols: str) -> Column:
    inf = F.lit(float("inf"))
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < inf) for c in cols])


def points(df: DataFrame) -> DataFrame:
    """(idx, x, y, z) as DOUBLE, finite rows only."""
    return df.select("idx", *[F.col(a).cast("double").alias(a) for a in AXES]).where(finite(*AXES))


def _from_points(df: DataFrame) -> DataFrame:
    return df.select("idx", *[F.col(a).cast("double").alias(f"{m}_{a}") for m in ("min", "max") for a in AXES])


def _from_triangles(df: DataFrame) -> DataFrame:
    def bound(f, i):
        return f(*[F.col(v)[i].cast("double") for v in ("v0", "v1", "v2")])

    # least() and greatest() skip nulls, so incomplete triangles are dropped here
    whole = reduce(lambda a, b: a & b, [F.col(v)[i].isNotNull() for v in ("v0", "v1", "v2") for i in range(3)])
    cols = [bound(f, i).alias(f"{m}_{a}") for m, f in (("min", F.least), ("max", F.greatest)) for i, a in enumerate(AXES)]
    return df.where(whole).select("idx", *cols)


def _from_boxes(df: DataFrame) -> DataFrame:
    return df.select("idx", *[F.col(c).cast("double").alias(c) for c in BOX])


register_primitive("points", _from_points)
register_primitive("triangles", _from_triangles)
register_primitive("boxes", _from_boxes)


def canonicalize(df: DataFrame, kind: str = "points") -> DataFrame:
    """(idx, min_x .. max_z) of any registered kind."""
    if kind not in _KINDS:
        raise ValueError(f"unknown primitive kind {kind!r}; known: {sorted(_KINDS)}")
    return _KINDS[kind](df).where(finite(*BOX))


def require_two(n: int) -> None:
    if n < 2:
        raise ValueError("an index needs at least two primitives")
