"""Small matrices as ARRAY<DOUBLE>, row by row, in column expressions [native]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


def at(m: Column, i, j, cols) -> Column:
    """Entry (i, j), counted from 0, of a matrix of `cols` columns."""
    return F.element_at(m, (i * cols + j + 1).cast("int") if isinstance(i, Column) or isinstance(j, Column) else F.lit(i * cols + j + 1))


def places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def transpose(m: Column, n: int, k: int) -> Column:
    """The k x n transpose of an n x k matrix."""
    return F.transform(places(n * k), lambda p: at(m, F.pmod(p, F.lit(n)), F.floor(p / n), k))


def identity(n: int) -> Column:
    return F.transform(places(n * n), lambda p: (F.floor(p / n) == F.pmod(p, F.lit(n))).cast("double"))


def row_of(m: Column, i, k: int) -> Column:
    return F.slice(m, (i * k + 1).cast("int") if isinstance(i, Column) else i * k + 1, k)


def times_vector(m: Column, x: Column, n: int, k: int) -> Column:
    """M x of an n x k matrix."""
    return F.transform(places(n), lambda i: V.dot(row_of(m, i, k), x))


def vector_times(x: Column, m: Column, n: int, k: int) -> Column:
    """x' M of an n x k matrix."""
    return V.let(transpose(m, n, k), lambda t: times_vector(t, x, k, n))


def times(a: Column, b: Column, n: int, m: int, k: int) -> Column:
    """A B of an n x m and an m x k matrix."""
    return V.let(transpose(b, m, k), lambda bt: F.transform(places(n * k), lambda p: V.dot(row_of(a, F.floor(p / k), m), row_of(bt, F.pmod(p, F.lit(k)), m))))


def _minor(m: Column, i: int, j: int) -> Column:
    """Cofactor (i, j) of a 3 x 3 matrix: rows and columns taken round."""
    a, b, c, d = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
    return at(m, a, c, 3) * at(m, b, d, 3) - at(m, a, d, 3) * at(m, b, c, 3)


def determinant3(m: Column) -> Column:
    return sum((at(m, 0, j, 3) * _minor(m, 0, j) for j in range(1, 3)), at(m, 0, 0, 3) * _minor(m, 0, 0))


def inverse3(m: Column) -> Column:
    """Inverse of a 3 x 3 matrix; zeros where the determinant is 0."""

    def whole(x: Column) -> Column:
        f = F.when(x["det"] != 0, 1 / x["det"]).otherwise(0.0)
        return F.array(*[_minor(x["m"], j, i) * f for i in range(3) for j in range(3)])

    return V.let(V.let(m, lambda x: F.struct(x.alias("m"), determinant3(x).alias("det"))), whole)


def affine_inverse(m: Column) -> Column:
    """Inverse of an affine 4 x 4 matrix (its last row is 0 0 0 1); zeros where it has none."""

    def whole(x: Column) -> Column:
        back, moved = x["back"], x["moved"]
        rows = [y for i in range(3) for y in (*[at(back, i, j, 3) for j in range(3)], -F.element_at(moved, i + 1))]
        return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.when(F.exists(back, lambda y: y != 0), 1.0).otherwise(0.0))

    def parts(x: Column) -> Column:
        return F.struct(inverse3(F.array(*[at(x, i, j, 4) for i in range(3) for j in range(3)])).alias("back"), F.array(*[at(x, i, 3, 4) for i in range(3)]).alias("shift"))

    return V.let(V.let(V.let(m, parts), lambda x: F.struct(x["back"].alias("back"), times_vector(x["back"], x["shift"], 3, 3).alias("moved"))), whole)


def trace(m: Column, n: int) -> Column:
    return sum((at(m, i, i, n) for i in range(1, n)), at(m, 0, 0, n))


def least_squares2(x: Column, y: Column, z: Column) -> Column:
    """struct(a, b) of least |a x + b y - z|, by the normal equations; null where x and y are parallel."""
    products = F.struct(*[V.dot(p, q).alias(n) for n, p, q in (("xx", x, x), ("xy", x, y), ("yy", y, y), ("xz", x, z), ("yz", y, z))])

    def solve(s: Column) -> Column:
        det = F.nullif(s["xx"] * s["yy"] - s["xy"] * s["xy"], F.lit(0.0))
        return F.struct(((s["xz"] * s["yy"] - s["yz"] * s["xy"]) / det).alias("a"), ((s["yz"] * s["xx"] - s["xz"] * s["xy"]) / det).alias("b"))

    return V.let(products, solve)


def singular_values2(m: Column) -> Column:
    """Both singular values of a 2 x 2 matrix, the larger first."""
    a, b, c, d = (F.element_at(m, i) for i in range(1, 5))
    s, t = F.sqrt((a + d) * (a + d) + (b - c) * (b - c)), F.sqrt((a - d) * (a - d) + (b + c) * (b + c))
    return F.array((s + t) / 2, F.abs(s - t) / 2)
