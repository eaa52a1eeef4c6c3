"""Baseline models by segment: ridge and Poisson regressions behind imputation and scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wide


def usable(df: DataFrame, columns: Sequence[str], masked: Sequence[str] = ()) -> list[str]:
    """The columns that have values and aren't among the masked ones."""
    n = wide.moments(df, columns)[0]
    return [c for c, x in zip(columns, n) if x and c not in set(masked)]


@dataclass
class Prepared:
    """Median imputation, missing indicators and standardisation, as fitted."""

    medians: dict[str, float]
    indicators: list[str]
    scale: dict[str, tuple[float, float]]

    def columns(self) -> list[Column]:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()}
        filled |= {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.indicators}
        return [((filled[n] - m) / s).alias(f"z_{n}") for n, (m, s) in self.scale.items()]


def prepare(df: DataFrame, features: Sequence[str]) -> Prepared:
    """Fit on ``df``: exact medians, an indicator for each feature with nulls, population deviations (1 if 0)."""
    n, *_, low, high = wide.moments(df, features)
    rows = df.count()
    middle = [[math.floor((m - 1) / 2), math.ceil((m - 1) / 2)] if m else [] for m in n]
    found = wide.values_at(df, features, middle, np.stack([low, high]))
    medians = {c: (v[0] + v[1]) / 2 if v else 0.0 for c, v in zip(features, found)}
    indicators = [c for c, m in zip(features, n) if m < rows]
    cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in features} | {f"{c}_missing": F.col(c).isNull().cast("double") for c in indicators}
    m, mean, square, *_ = wide.moments(df.select(*[v.alias(k) for k, v in cols.items()]), list(cols))
    return Prepared(medians, indicators, {k: (float(mean[i]), float(np.sqrt(square[i] / max(m[i], 1))) or 1.0) for i, k in enumerate(cols)})


@dataclass
class Fitted:
    prepared: Prepared
    weights: np.ndarray
    intercept: float
    link: str

    def predict(self) -> Column:
        eta = F.lit(self.intercept)
        for c, w in zip(self.prepared.columns(), self.weights.tolist()):
            eta = eta + c * w
        return F.exp(eta) if self.link == "log" else eta


def _vectors(df: DataFrame, prepared: Prepared, label: str) -> DataFrame:
    z = df.select(F.col(label).cast("double").alias("label"), *prepared.columns())
    return VectorAssembler(inputCols=[c for c in z.columns if c != "label"], outputCol="features").transform(z).select("label", "features")


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> Fitted | None:
    """Least squares with penalty ``alpha`` on the squared weights, in closed form; None without rows."""
    rows = df.where(F.col(label).isNotNull())
    n, sd = rows.agg(F.count("*"), F.stddev_pop(F.col(label).cast("double"))).first()
    if not n:
        return None
    p = prepare(rows, features)
    if not sd:
        return Fitted(p, np.zeros(len(p.scale)), float(rows.agg(F.avg(label)).first()[0]), "identity")
    m = LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha / n * sd).fit(_vectors(rows, p, label))
    return Fitted(p, m.coefficients.toArray(), m.intercept, "identity")


def fit_poisson(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, steps: int = 100) -> Fitted | None:
    """Poisson regression with log link, penalty alpha / 2 on the squared weights per row; None without positive labels."""
    rows = df.where(F.col(label).isNotNull())
    mean = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if not mean:
        return None
    p = prepare(rows, features)
    m = GeneralizedLinearRegression(family="poisson", link="log", regParam=alpha / mean, maxIter=steps, tol=1e-10).fit(_vectors(rows, p, label))
    return Fitted(p, m.coefficients.toArray(), m.intercept, "log")


def by_segment(df: DataFrame, segment: str, models: dict[str, Fitted | None]) -> Column:
    """Each row's prediction by its segment's model; null where there is none."""
    out = F.lit(None).cast("double")
    for name, m in models.items():
        if m is not None:
            out = F.when(F.col(segment) == name, m.predict()).otherwise(out)
    return out


def two_stage(minutes: Column, given_play: Column) -> Column:
    """P(play), taken as predicted minutes / 90 within [0, 1], times the component given play."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), minutes / 90)) * given_play
