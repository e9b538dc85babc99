"""Grouped regression, false-discovery rates, factor scores, histograms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.operators.ranges import numbered, parts_for, settled


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + num * d)
            c = away(1 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b: float, x):
    """The regularised incomplete beta function of arrays a and x and one b."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - math.lgamma(b) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1) / (a + b + 2)
    # The fraction converges fast on one side only; the other follows by symmetry, a and b exchanged.
    direct = front * _beta_fraction(a, b, np.where(low, y, 0.0)) / a
    mirror = 1 - front * _beta_fraction(np.full_like(a, b), a, np.where(low, 0.0, 1 - y)) / b
    return np.where(inside, np.where(low, direct, mirror), np.clip(x, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def t_two_sided(r2: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation with the given r squared over n points; null under 3 points."""
    r2, df = r2.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan) - 2
    known = ~np.isnan(r2) & (df > 0)
    rho, free = np.where(known, np.clip(r2, 0.0, 1.0), 0.5), np.where(known, df, 1.0)
    # df / (df + t squared) is 1 - r squared.
    p = incomplete_beta(free / 2, 0.5, 1 - rho)
    return pd.Series(p).where(known, None)


def significant(x: Column, digits: int = 12) -> Column:
    """A double as it is when written with so many significant digits: orders by what a table shows."""
    return F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double")


def ordered_results(results: DataFrame, p: str = "p", slope: str = "slope", key: str = "motif") -> DataFrame:
    """Regression results as a table shows them: by p, then |slope| descending, both to 12 digits, then by name."""
    return results.orderBy(significant(F.col(p)), -significant(F.abs(F.col(slope))), key)


def regression(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, slope, intercept, r, n, p of y on x per group; groups whose x is constant are dropped."""
    out = points.groupBy(by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")
    )
    # A row for each group.  p is made by as few tasks, with a Python worker each, as the rows fill, and
    # written: a filter on p would be pushed before the dealing and make it again there.
    out = settled(out.where(F.col("slope").isNotNull() & ~F.isnan("slope")))
    out = out.repartition(parts_for(out.sparkSession, out.count()))
    r = F.signum("slope") * F.sqrt("r2")
    return settled(out.select(by, "slope", "intercept", r.alias("r"), "n", t_two_sided(F.col("r2"), F.col("n").cast("double")).alias("p")))


def join_expression(matrix: DataFrame, expression: DataFrame) -> DataFrame:
    """(tf, gene, score) with (gene, value): an inner join that keeps every multiplicity."""
    return matrix.join(expression, "gene")


def transform_response(y, kind: str):
    return {"log2": F.log2(y + 0.1), "log10": F.log10(y + 0.1)}[kind]


def bh_qvalues(tests: DataFrame, p: str = "p", slope: str = "slope", key: str = "motif") -> DataFrame:
    """q = min(1, n * p / rank), rank by (p, |slope| descending, key); without a step-up."""
    known = tests.where(F.col(p).isNotNull())
    ranked = numbered(known, [F.col(p), -F.abs(F.col(slope)), F.col(key)], "_rank", start=1)
    n = ranked.agg(F.count("*").alias("_n"))  # one row
    return ranked.crossJoin(F.broadcast(n)).withColumn("q", F.least(F.lit(1.0), F.col("_n") * F.col(p) / F.col("_rank"))).drop("_n", "_rank")


def factor_scores(results: DataFrame, names, p: str = "p", threshold: float = 0.01, by: str | None = None) -> DataFrame:
    """Greatest -log2 p of each factor among clusters with p (or ``by``) at most the threshold; p = 1 is skipped."""
    kept = results.where((F.col(by or p) <= threshold) & (F.col(p) < 1))
    return kept.select(F.explode(names).alias("tf"), (-F.log2(p)).alias("score")).groupBy("tf").agg(F.max("score").alias("score")).orderBy("tf")


def max_abs(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """The signed value of greatest magnitude for each key; the positive one of two alike."""
    return scores.groupBy(*keys).agg(F.coalesce(F.max_by(value, F.struct(F.abs(value), F.col(value))), F.lit(0.0)).alias(value))


def avg_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("avg"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def kl_divergence(p: DataFrame, q: DataFrame, on: str) -> DataFrame:
    """Sum of p ln(p / q) over bins where both are positive."""
    both = p.select(on, F.col("share").alias("p")).join(q.select(on, F.col("share").alias("q")), on).where("p > 0 AND q > 0")
    return both.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
