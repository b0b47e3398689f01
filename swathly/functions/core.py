"""Small helpers for column arithmetic on vectors and matrices kept as Python lists of columns."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = list[Column]
Mat = list[list[Column]]


def col(x) -> Column:
    """A column from a column, a name or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def vec(*xs) -> Vec:
    return [col(x) for x in xs]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(add, [x * y for x, y in zip(a, b, strict=True)])


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def plus(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def scale(a: Vec, k) -> Vec:
    return [x * k for x in a]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return [x / n for x in a]


def matvec(m: Mat, v: Vec) -> Vec:
    return [dot(row, v) for row in m]


def matmul(a: Mat, b: Mat) -> Mat:
    return [[dot(row, [b[k][j] for k in range(len(b))]) for j in range(len(b[0]))] for row in a]


def transpose(m: Mat) -> Mat:
    return [list(r) for r in zip(*m, strict=True)]


def det3(m: Mat) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def solve3(m: Mat, b: Vec, tiny: float = 1e-12) -> Vec:
    """Cramer's rule; null where the determinant vanishes."""
    d = det3(m)
    t = transpose(m)
    parts = [det3(transpose([b if k == j else t[k] for k in range(3)])) for j in range(3)]
    return [F.when(F.abs(d) > tiny, p / d) for p in parts]


def wrap_pi(a: Column) -> Column:
    """An angle difference in radians within (-pi, pi]."""
    return F.when(a > math.pi, a - 2 * math.pi).when(a < -math.pi, a + 2 * math.pi).otherwise(a)


def horner(coefficients: list[float], x: Column) -> Column:
    """Polynomial with the constant first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns worked out once per row, behind a generator of one row.

    The optimizer neither merges a generator with what comes after it nor pushes a filter on its
    columns below it, so a long formula is not copied into each of its uses.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__staged")
    return df.select("*", one).select("*", *[F.col(f"__staged.{n}").alias(n) for n in columns]).drop("__staged")
