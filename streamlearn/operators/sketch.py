"""Matrix sketches by frequent directions: per key, merged, and the buffered kind used for anomaly detection."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Transformer
from ..plans.fold import Fold, fold
from ..schemas import require
from ..streaming.state import stream_fold


def shrink(b: np.ndarray, ell: int, at: int) -> np.ndarray:
    """At most ell rows whose Gram matrix is that of b less the squared singular value number `at` (from 0)."""
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    delta = s[at] ** 2 if at < len(s) else 0.0
    s = np.sqrt(np.maximum(s**2 - delta, 0.0))
    keep = s > 1e-12 * max(1.0, s[0] if len(s) else 0.0)
    return (s[keep, None] * vt[keep])[:ell]


class _Directions(Fold):
    schema = "row int, data array<double>"

    def __init__(self, ell: int):
        self.ell = ell

    def start(self):
        return []

    def block(self, state, rows: pd.DataFrame):
        for x in rows["data"].tolist():
            if len(state) >= self.ell:
                state = list(shrink(np.array(state), self.ell, self.ell // 2))
            state.append(np.asarray(x, "f8"))
        return state, None

    def finish(self, state):
        return pd.DataFrame({"row": np.arange(len(state), dtype="i4"), "data": [x.tolist() for x in state]}) if state else None


class FrequentDirections(Transformer):
    """A sketch of at most ell rows per key with |A'A - B'B| bounded by the shrunk mass.

    A full sketch is compressed when the next row arrives, as many singular directions being dropped as free half of
    it; the rest is returned at the end. aggregate=True sketches the keys' sketches into one, in two steps: keys are
    first merged in `fan_in` groups, then those.
    """

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "ell": 1, "aggregate": False, "fan_in": 64}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        require(df, p["key"], p["order"], "data", operator="FrequentDirections")
        how = _Directions(p["ell"])
        if df.isStreaming:  # each key's sketch after every micro-batch
            rows = df.select(p["key"], F.col(p["order"]).alias("seq"), "data")
            return stream_fold(rows, [p["key"]], ["seq"], how, with_state=True)
        own = fold(df.select(p["key"], p["order"], "data"), [p["key"]], [p["order"]], how)
        if not p["aggregate"]:
            return own
        step = own.select(F.pmod(F.xxhash64(p["key"]), F.lit(p["fan_in"])).alias("group"), F.col(p["key"]).alias("from"), "row", "data")
        groups = fold(step, ["group"], ["from", "row"], how)
        return fold(groups.select(F.lit(0).alias("all"), "group", "row", "data"), ["all"], ["group", "row"], how).drop("all")


class _Buffered(Fold):
    schema = "row int, data array<double>"

    def __init__(self, ell: int):
        self.ell = ell

    def start(self):
        return []

    def rotate(self, b: np.ndarray) -> np.ndarray:
        _, s, vt = np.linalg.svd(b, full_matrices=False)
        if len(s) >= self.ell:
            s = np.sqrt(np.maximum(s[: self.ell] ** 2 - s[self.ell - 1] ** 2, 0.0))
            return s[:, None] * vt[: self.ell]
        return s[:, None] * vt

    def block(self, state, rows: pd.DataFrame):
        for x in rows["data"].tolist():
            state.append(np.asarray(x, "f8"))
            if len(state) >= 2 * self.ell:
                state = list(self.rotate(np.array(state)))
        return state, None

    def finish(self, state):
        first = state[: self.ell]
        return pd.DataFrame({"row": np.arange(len(first), dtype="i4"), "data": [x.tolist() for x in first]}) if first else None


class AnomalySketch(Transformer):
    """A buffer of 2 ell rows, rotated to ell when full; the result is its first ell rows after a last rotation."""

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "ell": 1}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        require(df, p["key"], p["order"], "data", operator="AnomalySketch")
        return fold(df.select(p["key"], p["order"], "data"), [p["key"]], [p["order"]], _Rotated(p["ell"]))


class _Rotated(_Buffered):
    def finish(self, state):
        return super().finish(list(self.rotate(np.array(state))) if len(state) > self.ell else state)
