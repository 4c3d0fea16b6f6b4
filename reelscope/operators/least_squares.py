"""Least squares over arrays, inside one expression per row: many small regressions at once, without leaving the engine.

The moment matrix of a regression holds the products of all pairs of its columns, added up.  Sweeping it on a column
solves for that column: after sweeping the inputs, the last column holds the coefficients, the last cell the
squared error, and the swept block minus the inverse of the moments.  A nested model is one sweep less, so trying
further inputs costs one step each.  Matrices are arrays in row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column that the swept ones explain up to this share of its moment is left out.
COLLINEAR = 1e-10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counting(first: Column, last: Column) -> Column:
    """The whole numbers from ``first`` to ``last``, none if that is smaller."""
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def moment_matrix(columns: Column) -> Column:
    """The matrix of an array of columns, each an array of as many numbers."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    def whole(held: Column) -> Column:
        size = F.size(held)
        # a product below the diagonal is that of the other side
        upper = F.transform(held, lambda a, i: F.transform(F.slice(held, i + 1, size - i), lambda b: dot(a, b)))
        return let(upper, lambda rows: F.flatten(F.transform(counting(F.lit(0), size - 1), lambda i: F.transform(
            counting(F.lit(0), size - 1), lambda j: F.get(F.get(rows, F.least(i, j)), F.abs(i - j))
        ))))

    return let(columns, whole)


def _swept(matrix: Column, size: Column, at: Column, scale: Column) -> Column:
    """The matrix swept on column ``at``; unchanged if ``scale`` (its diagonal before any sweep) says it is collinear."""
    def on(pivot: Column) -> Column:
        def cell(x: Column, place: Column) -> Column:
            row, column = F.floor(place / size).cast("int"), place % size
            across, down = F.get(matrix, at * size + column), F.get(matrix, row * size + at)
            return (
                F.when((row == at) & (column == at), F.lit(-1.0) / pivot)
                .when(row == at, across / pivot).when(column == at, down / pivot)
                .otherwise(x - down * across / pivot)
            )

        return F.when(pivot > F.get(scale, at) * COLLINEAR, F.transform(matrix, cell)).otherwise(matrix)

    return let(F.get(matrix, at * size + at), on)


def sweep(matrix: Column, size: Column, steps: Column) -> Column:
    """A struct of the matrix ``m`` swept on columns 0 … ``steps`` - 1 and the squared ``errors`` after each of them."""
    def run(given: Column) -> Column:
        scale = F.transform(counting(F.lit(0), size - 1), lambda i: F.get(given, i * size + i))
        start = F.struct(given.alias("m"), scale.alias("scale"), F.array().cast("array<double>").alias("errors"))

        def noted(held: Column) -> Column:  # the error before a sweep is that after the one before
            return F.concat(held["errors"], F.array(F.element_at(held["m"], -1)))

        def step(held: Column, at: Column) -> Column:
            return F.struct(
                _swept(held["m"], size, at, held["scale"]).alias("m"), held["scale"].alias("scale"),
                noted(held).alias("errors"),
            )

        return F.aggregate(counting(F.lit(0), steps - 1), start, step, lambda held: F.struct(
            held["m"].alias("m"), F.slice(noted(held), F.lit(2), steps.cast("int")).alias("errors")
        ))

    return let(matrix, run)


def coefficient(matrix: Column, size: Column, of: int) -> Column:
    """The coefficient of a swept column; 0 for one that was left out."""
    # the diagonal of a swept column is minus its inverse moment
    return F.when(F.get(matrix, size * of + of) < 0, F.get(matrix, size * of + size - 1)).otherwise(0.0)


def solve(columns: Column, inputs: int) -> Column:
    """The coefficients of the first ``inputs`` columns for the last one."""
    size = F.lit(inputs + 1)
    return let(
        sweep(moment_matrix(columns), size, F.lit(inputs))["m"],
        lambda m: F.array(*[coefficient(m, size, i) for i in range(inputs)]),
    )
