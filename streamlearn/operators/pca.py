"""Incremental principal components and the anomaly statistics that use them."""

from __future__ import annotations

from statistics import NormalDist
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Predictor, Transformer
from ..functions.vectors import dot
from ..plans.fold import Fold, fold
from ..schemas import require
from ..streaming.state import stream_fold


def ccipca(rows: np.ndarray, n: int, amnesic: float, state: tuple[int, np.ndarray] | None = None) -> tuple[int, np.ndarray]:
    """Candid covariance-free steps: unnormalised components (rows of v) after further rows. The first n rows start v."""
    t, v = state if state else (0, np.zeros((0, rows.shape[1])))
    v = v.copy()
    for x in rows:
        t += 1
        if len(v) < n:
            v = np.vstack([v, x])
            if len(v) == n:
                start = v.copy()
                for s in range(1, n + 1):
                    v = _ccipca_step(v, start[s - 1], s, amnesic)
            continue
        v = _ccipca_step(v, x, t, amnesic)
    return t, v


def _ccipca_step(v: np.ndarray, x: np.ndarray, t: int, amnesic: float) -> np.ndarray:
    u = x.astype("f8")
    for i in range(min(len(v), t)):
        size = np.linalg.norm(v[i])
        if size == 0.0:
            continue
        v[i] = (t - 1 - amnesic) / t * v[i] + (1 + amnesic) / t * u * (u @ v[i]) / size
        size = np.linalg.norm(v[i])
        if size == 0.0:
            continue
        w = v[i] / size
        u = u - (u @ w) * w
    return v


class _Components(Fold):
    schema = "component int, value double, vector array<double>"

    def __init__(self, n: int, amnesic: float):
        self.n, self.amnesic = n, amnesic

    def start(self):
        return None

    def block(self, state, rows: pd.DataFrame):
        return ccipca(np.array(rows["data"].tolist(), "f8"), self.n, self.amnesic, state), None

    def finish(self, state):
        _, v = state
        size = np.linalg.norm(v, axis=1)
        order = np.argsort(-size, kind="stable")
        unit = [(v[i] / size[i] if size[i] else v[i]).tolist() for i in order]
        return pd.DataFrame({"component": np.arange(len(v), dtype="i4"), "value": size[order], "vector": unit})


class CCIPCA(Transformer):
    """Components of each key's (or batch's) rows in order: norm (value) and unit vector, largest first."""

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "components": 11, "amnesic": 2.5}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        require(df, p["key"], p["order"], "data", operator="CCIPCA")
        how = _Components(p["components"], p["amnesic"])
        if df.isStreaming:  # each key's components after every micro-batch
            return stream_fold(df.select(p["key"], F.col(p["order"]).alias("seq"), "data"), [p["key"]], ["seq"], how, with_state=True)
        return fold(df.select(p["key"], p["order"], "data"), [p["key"]], [p["order"]], how)


def _basis(vectors: list[list[float]]) -> list[Column]:
    return [F.array(*[F.lit(float(x)) for x in v]) for v in vectors]


def spe(data: Column, vectors: list[list[float]]) -> Column:
    """Squared prediction error |(I - P P') x|^2 for orthonormal P, as |x|^2 - |P'x|^2."""
    explained = F.lit(0.0)
    for b in _basis(vectors):
        explained = explained + F.pow(dot(data, b), F.lit(2.0))
    return F.greatest(F.lit(0.0), dot(data, data) - explained)


def hotelling(data: Column, vectors: list[list[float]], values: list[float]) -> Column:
    """x' P diag(values)^-1 P' x; vectors and values are in the same order."""
    out = F.lit(0.0)
    for b, v in zip(_basis(vectors), values):
        out = out + F.pow(dot(data, b), F.lit(2.0)) / F.lit(float(v))
    return out


def q_limit(values: list[float], confidence: float = 0.98, form: str = "reference") -> float:
    """Limit of the squared prediction error from the left-out values; form="classic" is Jackson and Mudholkar's."""
    t1, t2, t3 = (sum(v**k for v in values) for k in (1, 2, 3))
    h = 1 - 2 * t1 * t3 / (3 * t2**2)
    z = NormalDist().inv_cdf(confidence)
    if form == "classic":
        return t1 * (z * (2 * t2 * h * h) ** 0.5 / t1 + 1 + t2 * h * (h - 1) / t1**2) ** (1 / h)
    inner = h * z * 2 * t2
    return float("nan") if inner < 0 else (t1 * (inner**0.5 / t1 + 1 + t2 * h * (h - 1) / t1**2)) ** (1 / h)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_limit(values: list[float], confidence: float = 0.98) -> float:
    """Chi-squared quantile with as many degrees of freedom as values, by bisection."""
    k = len(values)
    low, high = 0.0, 10.0 * k + 100.0
    for _ in range(200):
        middle = (low + high) / 2
        if gamma_p(k / 2, middle / 2) < confidence:
            low = middle
        else:
            high = middle
    return (low + high) / 2


class PCAAnomaly(Predictor):
    """Fits components (kept ones and the values of the rest) and flags rows beyond either limit."""

    defaults: dict[str, Any] = {"order": "seq", "components": 11, "kept": 3, "amnesic": 2.5, "confidence": 0.98}

    def fit(self, df: DataFrame, **params: Any) -> PCAAnomaly:
        p = self._merged(self.params, params)
        rows = CCIPCA(key="__all", order=p["order"], components=p["components"], amnesic=p["amnesic"]).transform(df.withColumn("__all", F.lit(0)))
        found = rows.orderBy("component").collect()  # as many as components
        out = self.with_params(**params)
        vectors = np.linalg.qr(np.array([r.vector for r in found[: p["kept"]]]).T)[0].T
        out.vectors, out.values, out.rest = vectors.tolist(), [r.value for r in found[: p["kept"]]], [r.value for r in found[p["kept"] :]]
        return out

    def _predict(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        if not hasattr(self, "vectors"):
            raise RuntimeError("PCAAnomaly is not fitted")
        x = F.col("data")
        q, t = q_limit(self.rest, p["confidence"], "classic") if self.rest else float("inf"), t_limit(self.values, p["confidence"])
        out = df.withColumns({"spe": spe(x, self.vectors), "t2": hotelling(x, self.vectors, self.values)})
        return out.withColumn("anomaly", (F.col("spe") > F.lit(q)) | (F.col("t2") > F.lit(t)))
