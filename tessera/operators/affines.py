"""Geometry by row: 4 x 4 affines and dimensions that stand in columns.

An affine is an ``array<double>`` of its 16 values, row by row, that takes 1-based voxel
indices to millimetres; its last row is 0 0 0 1. Dimensions are an ``array<int>``. Every
volume of a table has its own, and all of it is expressions: matrices are multiplied and
inverted where their row is. A missing matrix, one with a missing value, one of another
length and the inverse of a singular one are NULL, and so is what is made of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column, its name, or the 16 values of a literal matrix.
Matrix = Column | str | Sequence[float]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_matrix(m: Matrix) -> Column:
    """The matrix as a column; NULL unless it has 16 values that are there."""
    if not isinstance(m, (Column, str)):
        values = [float(x) for row in m for x in (row if hasattr(row, "__len__") else [row])]
        if len(values) != 16:
            raise ValueError(f"a matrix of {len(values)} values")
        return F.array(*map(F.lit, values))
    c = F.col(m) if isinstance(m, str) else m
    return F.when((F.size(c) == 16) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), c)


def _dims(dim: Column | str | Sequence[int]) -> Column:
    if isinstance(dim, str):
        return F.col(dim)
    return dim if isinstance(dim, Column) else F.array(*(F.lit(int(n)) for n in dim))


def _at(m: Column, r: int, c: int) -> Column:
    return F.get(m, F.lit(4 * r + c))


def _rows(top: Sequence[Sequence[Column]]) -> Column:
    """A matrix of its three upper rows."""
    return F.array(*(x for row in top for x in row), *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))


def product(a: Matrix, b: Matrix) -> Column:
    """a b."""

    def made(x: Column, y: Column) -> Column:
        cells = [[sum((_at(x, r, k) * _at(y, k, c) for k in range(1, 3)), _at(x, r, 0) * _at(y, 0, c)) + (_at(x, r, 3) if c == 3 else F.lit(0.0)) for c in range(4)] for r in range(3)]
        return F.when(x.isNotNull() & y.isNotNull(), _rows(cells))

    return bound(as_matrix(a), lambda x: bound(as_matrix(b), lambda y: made(x, y)))


def determinant(m: Matrix) -> Column:
    """Of the upper left 3 x 3 part."""
    minor = lambda x, c: _at(x, 1, (c + 1) % 3) * _at(x, 2, (c + 2) % 3) - _at(x, 1, (c + 2) % 3) * _at(x, 2, (c + 1) % 3)
    return bound(as_matrix(m), lambda x: _at(x, 0, 0) * minor(x, 0) + _at(x, 0, 1) * minor(x, 1) + _at(x, 0, 2) * minor(x, 2))


def inverse(m: Matrix) -> Column:
    """By cofactors; NULL if the matrix has none."""

    def made(x: Column, d: Column) -> Column:
        cofactor = lambda r, c: _at(x, (c + 1) % 3, (r + 1) % 3) * _at(x, (c + 2) % 3, (r + 2) % 3) - _at(x, (c + 1) % 3, (r + 2) % 3) * _at(x, (c + 2) % 3, (r + 1) % 3)
        turned = F.array(*(cofactor(r, c) / d for r in range(3) for c in range(3)))
        moved = lambda t: _rows([[*(F.get(t, F.lit(3 * r + c)) for c in range(3)), -sum((F.get(t, F.lit(3 * r + c)) * _at(x, c, 3) for c in range(1, 3)), F.get(t, F.lit(3 * r)) * _at(x, 0, 3))] for r in range(3)])
        return F.when((d != 0) & x.isNotNull(), bound(turned, moved))

    # Where the determinant is 0 the division is by NULL, which is no error in any mode.
    return bound(as_matrix(m), lambda x: bound(F.nullif(determinant(x), F.lit(0.0)), lambda d: made(x, d)))


def left_divide(a: Matrix, b: Matrix) -> Column:
    """What a takes to b: the inverse of a, times b."""
    return product(inverse(a), b)


def right_divide(a: Matrix, b: Matrix) -> Column:
    """a times the inverse of b."""
    return product(a, inverse(b))


def voxel_size(m: Matrix) -> Column:
    """Lengths of the first three columns, as an array."""
    return bound(as_matrix(m), lambda x: F.when(x.isNotNull(), F.array(*(F.sqrt(sum((_at(x, r, c) * _at(x, r, c) for r in range(1, 3)), _at(x, 0, c) * _at(x, 0, c))) for c in range(3)))))


def _diagonal(size: Sequence[Column], shift: Sequence[Column]) -> Column:
    return _rows([[size[r] if r == c else F.lit(0.0) for c in range(3)] + [shift[r]] for r in range(3)])


def upright_origin(m: Matrix, dim: Column | str | Sequence[int]) -> Column:
    """An axis-aligned affine of the same voxel sizes with the grid's middle at 0. A mirrored
    affine keeps its handedness through a negative first size."""
    n = _dims(dim)

    def made(s: Column, d: Column) -> Column:
        size = [F.get(s, F.lit(0)) * F.when(d < 0, -1.0).otherwise(1.0), F.get(s, F.lit(1)), F.get(s, F.lit(2))]
        return F.when(s.isNotNull() & n.isNotNull(), _diagonal(size, [-(x * (F.get(n, F.lit(a)) + 1) / 2) for a, x in enumerate(size)]))

    return bound(voxel_size(m), lambda s: bound(determinant(m), lambda d: made(s, d)))


def resized(m: Matrix, dim: Column | str | Sequence[int], size: Sequence[float]) -> tuple[Column, Column]:
    """Affine and dimensions for another voxel size (0 counts as 1); dimensions round down."""
    want = [float(s) or 1.0 for s in size]
    scale = F.array(*(F.get(voxel_size(m), F.lit(a)) / w for a, w in enumerate(want)))
    grown = bound(scale, lambda r: product(m, _diagonal([F.try_divide(F.lit(1.0), F.get(r, F.lit(a))) for a in range(3)], [F.lit(0.0)] * 3)))
    n = _dims(dim)
    return grown, bound(scale, lambda r: F.when(F.get(r, F.lit(0)).isNotNull() & n.isNotNull(), F.array(*(F.floor(F.get(r, F.lit(a)) * F.get(n, F.lit(a))).cast("int") for a in range(3)))))


def translated(m: Matrix, shift: Sequence[float]) -> Column:
    """Moved in millimetres."""
    return product(_diagonal([F.lit(1.0)] * 3, [F.lit(float(s)) for s in shift]), m)


def applied(m: Matrix, at: Sequence[Column]) -> Column:
    """Where the affine takes a point, as an array of three."""
    return bound(as_matrix(m), lambda x: F.when(x.isNotNull(), F.array(*(_at(x, r, 3) + sum((_at(x, r, c) * at[c] for c in range(1, 3)), _at(x, r, 0) * at[0]) for r in range(3)))))


def _away(x: Column) -> Column:
    """Rounded, halves away from 0."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def corners_box(m: Matrix, dim: Column | str | Sequence[int]) -> tuple[Column, Column]:
    """Smallest and largest coordinates of the eight corners, halves rounded away from 0."""
    n = _dims(dim)
    ends = [(F.lit(1.0), F.get(n, F.lit(a)).cast("double")) for a in range(3)]
    corners = F.array(*(applied(m, (x, y, z)) for x in ends[0] for y in ends[1] for z in ends[2]))
    along = lambda c, a: F.transform(c, lambda p: F.get(p, F.lit(a)))
    side = lambda f: bound(corners, lambda c: F.when(F.get(c, F.lit(0)).isNotNull() & n.isNotNull(), F.array(*(_away(f(along(c, a))) for a in range(3)))))
    return side(F.array_min), side(F.array_max)


def upright(m: Matrix, dim: Column | str | Sequence[int]) -> tuple[Column, Column]:
    """Affine and dimensions of the axis-aligned grid that covers a volume's corners."""
    low, high = corners_box(m, dim)

    def affine(s: Column, l: Column) -> Column:
        return F.when(s.isNotNull() & l.isNotNull(), _diagonal([F.get(s, F.lit(a)) for a in range(3)], [F.get(l, F.lit(a)) - F.get(s, F.lit(a)) for a in range(3)]))

    def shape(s: Column, l: Column, h: Column) -> Column:
        return F.when(s.isNotNull() & l.isNotNull(), F.array(*(F.ceil(F.try_divide(F.get(h, F.lit(a)) - F.get(l, F.lit(a)), F.get(s, F.lit(a))) + 1.0).cast("int") for a in range(3))))

    size = voxel_size(m)
    return bound(size, lambda s: bound(low, lambda l: affine(s, l))), bound(size, lambda s: bound(low, lambda l: bound(high, lambda h: shape(s, l, h))))


def slice_at(m: Matrix, point: Sequence[float], dim: Column | str | Sequence[int]) -> Column:
    """The voxel nearest to a point in millimetres, cut to the grid, as an array."""
    n = _dims(dim)
    at = applied(inverse(m), [F.lit(float(x)) for x in point])
    return bound(at, lambda p: F.when(p.isNotNull() & n.isNotNull(), F.array(*(F.least(F.greatest(F.floor(F.get(p, F.lit(a)) + 0.5).cast("int"), F.lit(1)), F.get(n, F.lit(a))) for a in range(3)))))


def voxel_of(p: Column, dim: Column | str | Sequence[int]) -> list[Column]:
    """1-based i, j, k of a 0-based place, first axis fastest."""
    nx, ny = (F.get(_dims(dim), F.lit(a)) for a in range(2))
    p = p.cast("long")
    return [(p % nx + 1).cast("int"), (F.floor(p / nx) % ny + 1).cast("int"), (F.floor(p / (nx.cast("long") * ny)) + 1).cast("int")]


def in_view(point: Column, dim: Column | str | Sequence[int]) -> Column:
    """At least 1 and below the dimension on every axis of a point's array; NULL is outside."""
    n = _dims(dim)
    tests = [(F.get(point, F.lit(a)) >= 1) & (F.get(point, F.lit(a)) < F.get(n, F.lit(a))) for a in range(3)]
    return F.coalesce(tests[0] & tests[1] & tests[2], F.lit(False))


def outside_view(data: Column | str, dim: Column | str, old_affine: Matrix, old_dim: Column | str | Sequence[int], new_affine: Matrix, value: float = 0.0) -> Column:
    """A volume's array on a new grid (``dim``, ``new_affine``), with the value where the old
    grid does not cover it. NULL where either affine is unusable."""
    d = F.col(data) if isinstance(data, str) else data

    def masked(m: Column) -> Column:
        return F.when(m.isNotNull(), F.transform(d, lambda x, p: F.when(in_view(applied(m, [c.cast("double") for c in voxel_of(p, dim)]), old_dim), x).otherwise(F.lit(value))))

    return bound(left_divide(old_affine, new_affine), masked)
