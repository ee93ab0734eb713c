"""Array expressions: everything stays in the JVM, one row at a time, without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def energy(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def unit(a: Column, least: float = 1e-12) -> Column:
    return F.transform(a, lambda x: x / F.greatest(F.sqrt(energy(a)), F.lit(least)))


def row(a: Column, i: int | Column, width: int) -> Column:
    """Row i of a row-major matrix."""
    return F.slice(a, F.lit(i) * width + 1, width)


def rows(a: Column, n: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(a, i * width + 1, width))


def without_dc(a: Column, n: int, width: int) -> Column:
    """Each row of the row-major matrix less its mean."""
    centred = F.transform(rows(a, n, width), lambda r: F.transform(r, lambda x: x - total(r) / width))
    return F.flatten(centred)


def peak_to_peak(a: Column, n: int, width: int) -> Column:
    return F.transform(rows(a, n, width), lambda r: F.array_max(r) - F.array_min(r))


def shifted(a: Column, by: int, width: int) -> Column:
    """Delayed by `by` samples (earlier if negative), zeros at the open end."""
    k = min(abs(by), width)
    zeros = F.array_repeat(F.lit(0.0), k)
    if by >= 0:
        return F.concat(zeros, F.slice(a, 1, width - k))
    return F.concat(F.slice(a, k + 1, width - k), zeros)


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def shares(a: Column) -> Column:
    """Each entry over the sum; an all-zero array puts the whole weight on its first slot."""
    first = F.transform(a, lambda _, i: (i == 0).cast("double"))
    return F.when(total(a) > 0, F.transform(F.array(total(a)), lambda s: F.transform(a, lambda x: x / s))[0]).otherwise(first)
