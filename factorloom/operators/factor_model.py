"""Factor risk model of many names: what depends on names or dates stays in tables, only K x K matrices are in the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scrub


@dataclass(frozen=True)
class RiskModel:
    """(instrument, loading..., specific, variance) of each name, annualized, and the factors' covariance."""

    names: DataFrame
    factor_cov: np.ndarray
    shrinkage: float
    n_eff: float


def _dot(row: list, columns: list[Column]) -> Column:
    return sum((F.lit(float(a)) * c for a, c in zip(row, columns)), F.lit(0.0))


def _row(df: DataFrame, **aggregates: Column) -> dict:
    return df.agg(*[c.alias(k) for k, c in aggregates.items()]).first().asDict()


def _matrix(row: dict, k: int) -> np.ndarray:
    return np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)


def _products(xs: list[Column], weight: Column | None = None) -> dict[str, Column]:
    return {f"p{i}_{j}": F.sum(xs[i] * xs[j] if weight is None else weight * xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))}


def factor_risk_model(returns: DataFrame, loadings: DataFrame, columns: list[str], min_obs: int = 2, ridge: float = 1e-3, shrink: float = 0.2, method: str = "fixed", estimator: str = "sample", halflife: float = 20.0, clip_sigma: float = 6.0, specific_shrink: float = 0.2, specific_clip: float = 0.99, days: int = 252) -> RiskModel | None:
    """B F B' + D from ``returns`` (datetime, instrument, ret) and one row of ``loadings`` for each name; None with too few dates or names.

    Loadings are standardized, missing ones as the median.  A date's factor returns are a ridge
    regression on them, and so a fixed matrix times sums over the date's names; they are clipped at
    ``clip_sigma`` deviations, and their covariance (plain, or weighted in time with a half-life) is
    shrunk to its diagonal (``fixed``) or to a scaled identity (``oas``).  A name's specific variance
    comes from its sums of returns, their squares and products with the factors, and from the
    factors' own sums: dates without a row are returns of zero, and need none.  Specific variances
    are clipped at a quantile and shrunk to their median.
    """
    k = len(columns)
    dates = returns.select("datetime").distinct()
    n_dates = dates.count()
    medians = _row(loadings, n=F.count("*"), **{f"m{j}": F.percentile(scrub(F.col(c).cast("double")), F.lit(0.5)) for j, c in enumerate(columns)})
    if n_dates < max(min_obs, 2) or medians["n"] < 4 or not k:
        return None
    filled = {c: F.coalesce(scrub(F.col(c).cast("double")), F.lit(medians[f"m{j}"]), F.lit(0.0)) for j, c in enumerate(columns)}
    ends = _row(loadings.select(*[x.alias(c) for c, x in filled.items()]), **{f"{s}{j}": f(c) for j, c in enumerate(columns) for s, f in (("a", F.avg), ("s", F.stddev_pop))})
    z = [f"_z{j}" for j in range(k)]
    known = loadings.select("instrument", *[((filled[c] - ends[f"a{j}"]) / (ends[f"s{j}"] if ends[f"s{j}"] > 1e-12 else 1.0)).alias(z[j]) for j, c in enumerate(columns)])
    zs = [F.col(c) for c in z]
    solver = np.linalg.inv(_matrix(_row(known, **_products(zs)), k) + ridge * np.eye(k))
    rows = returns.select("datetime", "instrument", F.coalesce(scrub(F.col("ret").cast("double")), F.lit(0.0)).alias("ret")).join(known, "instrument")
    sums = rows.groupBy("datetime").agg(*[F.sum(F.col("ret") * x).alias(f"_s{j}") for j, x in enumerate(zs)])
    f = [f"_f{j}" for j in range(k)]
    fs = [F.col(c) for c in f]
    # one row for each date
    w = Window.orderBy(F.col("datetime").desc())
    factors = dates.join(sums, "datetime", "left").select("datetime", *[_dot(solver[j], [F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(k)]).alias(f[j]) for j in range(k)])
    if clip_sigma > 0:
        sd = _row(factors, **{c: F.stddev_pop(c) for c in f})
        limit = {c: clip_sigma * sd[c] if sd[c] > 1e-12 else None for c in f}
        factors = factors.select("datetime", *[F.greatest(F.least(F.col(c), F.lit(limit[c])), F.lit(-limit[c])).alias(c) if limit[c] is not None else F.col(c) for c in f])
    age = F.row_number().over(w) - 1
    factors = factors.withColumn("_w", F.pow(F.lit(0.5), age / max(halflife, 1e-6)) if estimator == "ewm" else F.lit(1.0))
    total = _row(factors, w=F.sum("_w"), w2=F.sum(F.col("_w") * F.col("_w")), **{f"f{j}": F.sum(F.col("_w") * x) for j, x in enumerate(fs)}, **{f"g{j}": F.sum(x) for j, x in enumerate(fs)})
    mean = [total[f"f{j}"] / total["w"] for j in range(k)]
    cov = _matrix(_row(factors, **_products([x - m for x, m in zip(fs, mean)], F.col("_w") / total["w"])), k)
    effective = total["w"] ** 2 / total["w2"]
    if estimator != "ewm":
        cov = cov * n_dates / (n_dates - 1)
    used = shrink
    if method == "oas":
        trace, square = np.trace(cov), (cov * cov).sum()
        bottom = (effective + 1 - 2 / k) * (square - trace * trace / k)
        used = float(np.clip(((1 - 2 / k) * square + trace * trace) / bottom, 0.0, 1.0)) if bottom > 1e-18 else 0.0
    cov = (1 - used) * cov + used * (np.eye(k) * np.trace(cov) / k if method == "oas" else np.diag(np.diag(cov)))
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    cov = (vectors * np.maximum(values, 1e-12)) @ vectors.T * days
    square = _matrix(_row(factors, **_products(fs)), k)
    # of each name: sums of returns, of squares, of products with the factors
    own = rows.join(F.broadcast(factors), "datetime").groupBy("instrument").agg(F.sum("ret").alias("_r"), F.sum(F.col("ret") * F.col("ret")).alias("_rr"), *[F.sum(F.col("ret") * x).alias(f"_rf{j}") for j, x in enumerate(fs)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    first = zero("_r") - _dot([total[f"g{j}"] for j in range(k)], zs)
    second = zero("_rr") - 2 * sum((zero(f"_rf{j}") * x for j, x in enumerate(zs)), F.lit(0.0)) + sum((_dot(square[i], zs) * zs[i] for i in range(k)), F.lit(0.0))
    raw = known.join(own, "instrument", "left").select("instrument", *z, (F.greatest((second - first * first / n_dates) / (n_dates - 1), F.lit(0.0)) * days).alias("_d"))
    cut = _row(raw, q=F.percentile("_d", F.lit(specific_clip)))["q"] if 0 < specific_clip < 1 else 0.0
    capped = F.least("_d", F.lit(cut)) if cut > 0 else F.col("_d")
    middle = _row(raw.select(capped.alias("_d")), m=F.percentile("_d", F.lit(0.5)))["m"]
    specific = (1 - specific_shrink) * capped + specific_shrink * middle
    variance = sum((_dot(cov[i], zs) * zs[i] for i in range(k)), F.lit(0.0)) + F.col("specific")
    names = raw.withColumn("specific", specific).select("instrument", *[x.alias(c) for x, c in zip(zs, columns)], "specific", variance.alias("variance"))
    return RiskModel(names, cov, used, float(effective))
