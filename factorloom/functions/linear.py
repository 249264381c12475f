"""Least squares in column expressions: normal equations as an array, solved by elimination with diagonal pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from . import div


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def coefficients(df: DataFrame, xs: list[Column], y: Column, over: WindowSpec, product, ridge: float = 0.0, least: float = 1e-10, name: str = "_coef") -> DataFrame:
    """``df`` with the coefficients of the regression of y on the xs within each partition, as an array ``name``.

    ``product`` gives the aggregate of two terms (a sum of products, a covariance); ``ridge`` is added
    for each x.  The products are window aggregates of one partitioning, and one row of a partition
    solves for all of it; so the table is read once, and nothing is joined.
    """
    kept, terms, k = df.columns, [*xs, y], len(xs)
    cells = {(i, j): f"{name}_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)}
    df = df.withColumns({c: product(terms[i], terms[j]).over(over) for (i, j), c in cells.items()})
    matrix = F.array(*[F.col(cells[min(i, j), max(i, j)]) + (ridge if i == j < k else 0.0) for i in range(k + 1) for j in range(k + 1)])
    df = df.withColumns({f"{name}_m": matrix, f"{name}_row": F.row_number().over(over.orderBy(F.lit(0)))})
    df = df.withColumn(name, F.when(F.col(f"{name}_row") == 1, solve(F.col(f"{name}_m"), k, least)))
    return df.withColumn(name, F.first(name, ignorenulls=True).over(over)).select(*kept, name)


def solve(matrix: Column, k: int, least: float = 1e-10) -> Column:
    """The k coefficients of normal equations, the (k + 1) x (k + 1) matrix of products of the xs and then y, row by row.

    The matrix is scaled to a unit diagonal first.  The pivot is the largest diagonal element left
    (as in a pivoted Cholesky factorisation); when that is not above ``least``, the variables left
    depend on the others and get zero, which leaves fitted values as they are.
    """
    n = k + 1
    size = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.sqrt(F.greatest(F.element_at(matrix, i * (n + 1) + 1), F.lit(0.0))))
    cells, variables = F.sequence(F.lit(0), F.lit(n * n - 1)), F.sequence(F.lit(0), F.lit(k - 1))

    def at(m, i, j):
        return F.element_at(m, (i * n + j + 1).cast("int"))

    def of(c):
        return F.floor(c / n).cast("int"), c % n

    def scaled(c):
        i, j = of(c)
        return F.coalesce(div(F.element_at(matrix, c + 1), F.element_at(size, i + 1) * F.element_at(size, j + 1)), F.lit(0.0))

    def eliminated(m, p):
        def cell(c):
            i, j = of(c)
            row = at(m, p, j) / at(m, p, p)
            return F.when(i == p, row).otherwise(at(m, i, j) - at(m, i, p) * row)

        return F.transform(cells, cell)

    def step(state, _):
        m, used = state["m"], state["used"]
        diagonal = F.transform(variables, lambda i: F.when(F.array_contains(used, i), -1.0).otherwise(at(m, i, i)))
        pivot = _let(diagonal, lambda d: F.when(F.array_max(d) > least, (F.array_position(d, F.array_max(d)) - 1).cast("int")))
        return _let(pivot, lambda p: F.when(p.isNotNull(), F.struct(eliminated(m, p).alias("m"), F.array_append(used, p).alias("used"))).otherwise(F.struct(m.alias("m"), used.alias("used"))))

    start = F.struct(F.transform(cells, scaled).alias("m"), F.array().cast("array<int>").alias("used"))
    unscaled = lambda s: F.transform(variables, lambda i: F.when(F.array_contains(s["used"], i), div(at(s["m"], i, F.lit(k)) * F.element_at(size, k + 1), F.element_at(size, i + 1))).otherwise(0.0))
    return F.aggregate(variables, start, step, unscaled)
