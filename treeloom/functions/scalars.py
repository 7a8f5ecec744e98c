"""Scalar functions that Spark lacks, and small statistics helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _erfc_root(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(v / 2)) if v > 0 else 1.0)


@F.pandas_udf(T.StringType())
def _short_p(x: pd.Series) -> pd.Series:
    def one(v):
        if v is None or v != v:
            return None
        p = math.erfc(math.sqrt(v / 2)) if v > 0 else 1.0
        if p > 1e-300:
            return f"{p:.1E}"
        log10 = math.log10(2) - v * math.log10(math.e) / 2 - 0.5 * math.log10(2 * math.pi * v)
        whole = math.floor(log10)
        return f"{10 ** (log10 - whole):.1f}E{whole:d}"

    return x.map(one)


def chi2_pvalue(column: str | Column) -> Column:
    """Upper tail of the chi-squared distribution of one degree: erfc(sqrt(x / 2))."""
    return _erfc_root(F.col(column) if isinstance(column, str) else column)


def chi2_pvalue_text(column: str | Column) -> Column:
    """The tail in short form; below 1e-300 from the leading term of its logarithm."""
    return _short_p(F.col(column) if isinstance(column, str) else column)


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(absolute))


def relative_ratio(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))


def squared_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.sum(F.pow(F.col(a) - F.col(b), 2)).alias("l2"))


def squared_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.pow(F.corr(a, b), 2).alias("r2"))


def standardise(df: DataFrame, column: str, mask: str | None = None) -> DataFrame:
    """``column`` with mean 0 and sample variance 1; where ``mask`` is false it is -9."""
    used = df if mask is None else df.where(F.col(mask))
    s = used.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = (F.col(column) - F.col("_m")) / F.col("_s")
    z = z if mask is None else F.when(F.col(mask), z).otherwise(F.lit(-9.0))
    return df.crossJoin(F.broadcast(s)).withColumn(column, z).drop("_m", "_s")


def harrell_davis(values: list[float], share: float, grid: int = 20001) -> float:
    """The Harrell-Davis quantile: order statistics weighted by a beta distribution, whose
    mass over each step is integrated numerically."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    a, b = share * (n + 1), (1 - share) * (n + 1)
    t = np.linspace(0.0, 1.0, grid)[1:-1]
    log_pdf = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    mass = np.concatenate([[0.0], np.cumsum(np.exp(log_pdf)) / (grid - 1)])
    at = np.interp(np.arange(n + 1) / n, np.concatenate([[0.0], t]), mass)
    w = np.diff(at)
    return float((w * x).sum() / w.sum())


def harrell_davis_interval(values: list[float], share: float, level: float = 0.95, rounds: int = 200, seed: int = 1) -> tuple[float, float]:
    """Bootstrap interval of the quantile."""
    rng, x = np.random.default_rng(seed), np.asarray(values, dtype=float)
    found = [harrell_davis(rng.choice(x, len(x)), share) for _ in range(rounds)]
    return tuple(float(v) for v in np.quantile(found, [(1 - level) / 2, (1 + level) / 2]))
