"""Least squares with several regressors: mergeable centred cross-products, solved by elimination in expressions.

A group is reduced to its count, means and cross-products about the means; those of dates merge into those of windows without
another look at the rows and without losing digits where means are large.  The normal equations are a small matrix, and a fold
over its pivots solves them inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot below this share of its variable's spread is taken as none: the variable is a combination of those before it.
FLAT = 1e-10


def moments(rows: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by..., n, means, products) of the columns xs and, at last, y; rows with a null among them don't count."""
    names = [*xs, y]
    whole = rows.where(F.forall(F.array(*[F.col(c).isNotNull() for c in names]), lambda x: x))
    pairs = {(i, j): F.covar_pop(a, b) * F.count("*") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    products = F.array(*[F.array(*[pairs[min(i, j), max(i, j)] for j in range(len(names))]) for i in range(len(names))])
    return whole.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"), products.alias("products"))


def merged(parts: DataFrame, size: int, by: list[str]) -> DataFrame:
    """The moments of groups that ``parts`` make up; ``size``: the number of columns, y included."""
    n, places = F.col("n"), range(size)
    centre = parts.groupBy(*by).agg(F.sum("n").alias("__n"), F.array(*[F.sum(n * F.col("means")[i]) / F.sum("n") for i in places]).alias("__means"))
    off = [F.col("means")[i] - F.col("__means")[i] for i in places]
    sums = {(i, j): F.sum(F.col("products")[i][j] + n * off[i] * off[j]) for i in places for j in places if i <= j}
    products = F.array(*[F.array(*[sums[min(i, j), max(i, j)] for j in places]) for i in places])
    out = parts.join(centre, by).groupBy(*by, "__n", "__means").agg(products.alias("products"))
    return out.select(*by, F.col("__n").alias("n"), F.col("__means").alias("means"), "products")


def solved(products: Column, p: int) -> Column:
    """The coefficients of the first ``p`` variables for the last one; one that adds nothing to those before it has 0."""
    least = F.transform(products, lambda row, i: row[i] * FLAT)

    def eliminate(m: Column, k: Column) -> Column:
        pivot = m[k][k]
        flat = ~(pivot > F.greatest(least[k], F.lit(0.0)))
        scaled = F.transform(m[k], lambda v: v / pivot)
        without = lambda row, i: F.transform(row, lambda v, j: F.when((i == k) | (j == k), 0.0).otherwise(v))
        return F.transform(m, lambda row, i: F.when(flat, without(row, i)).when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - row[k] * b)))

    rows = F.slice(products, 1, p)
    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), rows, eliminate)
    return F.transform(done, lambda row: row[p])


def fit(parts: DataFrame, p: int, by: list[str]) -> DataFrame:
    """(by..., n, coefficients, intercept, r_squared) of moments; r_squared is null for a constant y."""
    coefficients = solved(F.col("products"), p)
    rows = parts.withColumn("coefficients", coefficients)
    told = F.aggregate(F.zip_with("coefficients", F.transform(F.slice("products", 1, p), lambda row: row[p]), lambda b, s: b * s), F.lit(0.0), lambda a, b: a + b)
    centre = F.aggregate(F.zip_with("coefficients", F.slice("means", 1, p), lambda b, m: b * m), F.lit(0.0), lambda a, b: a + b)
    total = F.col("products")[p][p]
    return rows.select(*by, "n", "coefficients", (F.col("means")[p] - centre).alias("intercept"), F.when(total > 0, told / total).alias("r_squared"))


def fitted_value(xs: list[str]) -> Column:
    """intercept + coefficients * xs, for rows that carry a fit."""
    out = F.col("intercept")
    for i, x in enumerate(xs):
        out = out + F.col("coefficients")[i] * F.col(x)
    return out


def residuals(rows: DataFrame, y: str, xs: list[str], by: list[str], name: str = "residual") -> DataFrame:
    """``rows`` with what is left of y in its group when the xs have told what they can."""
    models = fit(moments(rows, y, xs, by), len(xs), by).drop("n", "r_squared")
    return rows.join(models, by).withColumn(name, F.col(y) - fitted_value(xs)).drop("coefficients", "intercept")
