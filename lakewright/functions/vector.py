"""Vector expressions over arrays: dot products, norms, masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """The vector divided by its length (plus a tiny constant)."""
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / n)


def masked(a: Column, positions: tuple[int, ...]) -> Column:
    """The vector with zeros at the given positions (from 0)."""
    return F.transform(a, lambda x, i: F.when(i.isin(*positions), F.lit(0.0)).otherwise(x))


def sound(a: Column) -> Column:
    """No null, NaN or infinite component."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def joined(*parts: Column) -> Column:
    """Feature blocks one after the other; null if a block is null."""
    return F.concat(*parts)


def block(a: Column, start: int, n: int) -> Column:
    """``n`` components from position ``start`` (from 0)."""
    return F.slice(a, start + 1, n)
