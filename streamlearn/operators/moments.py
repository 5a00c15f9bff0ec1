"""Running, merged, weighted, exponentially weighted and sliding-window moments of feature vectors."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Transformer
from ..plans.fold import Fold, fold
from ..plans.keyed import keyed
from ..plans.running import running
from ..schemas import require
from ..streaming.state import stream_fold


def per_feature(df: DataFrame, keys: list[str], *, weighted: bool = False, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """A row for each feature that an event carries: keys, keep, feature, x (and w)."""
    zipped = F.arrays_zip("slice", "data", "weight") if weighted else F.arrays_zip("slice", "data")
    out = df.select(*keys, *[c for c in keep if c not in keys], F.explode(zipped).alias("z"))
    return out.select(*keys, *[c for c in keep if c not in keys], F.col("z.slice").alias("feature"), F.col("z.data").alias("x"), *([F.col("z.weight").alias("w")] if weighted else []))


class _Running(Fold):
    """Moments of each feature after every event, for streams."""

    def __init__(self, weighted: bool, order_type: str):
        self.weighted = weighted
        self.schema = f"seq {order_type}, feature int, n bigint, {'weight double, ' * weighted}mean double, variance double"

    def start(self):
        return {}

    def block(self, state, rows: pd.DataFrame):
        parts = []
        for f, g in rows.groupby("feature", sort=False):
            n, weight, mean, m2 = state.get(int(f), (0, 0.0, None, 0.0))
            x = g["x"].to_numpy("f8")
            w = g["w"].to_numpy("f8") if self.weighted else np.ones(len(x))
            d = x - (x[0] if mean is None else mean)  # sums around the mean so far: no cancellation
            total, s1, s2 = weight + np.cumsum(w), np.cumsum(w * d), m2 + np.cumsum(w * d * d)
            count = n + np.arange(1, len(x) + 1)
            means, sums = (x[0] if mean is None else mean) + s1 / total, np.maximum(0.0, s2 - s1 * s1 / total)
            variance = sums / total if self.weighted else np.where(count > 1, sums / np.maximum(1, count - 1), np.nan)
            out = {"seq": g["seq"].to_numpy(), "feature": np.int32(f), "n": count, "weight": total, "mean": means, "variance": variance}
            parts.append(pd.DataFrame(out))
            state[int(f)] = (int(count[-1]), float(total[-1]), float(means[-1]), float(sums[-1]))
        return state, pd.concat(parts)


def _stream_running(rows: DataFrame, key: str, order: str, weighted: bool) -> DataFrame:
    rows = rows.select(key, F.col(order).alias("seq"), "feature", "x", *["w"] * weighted)
    out = stream_fold(rows, [key], ["seq"], _Running(weighted, rows.schema["seq"].dataType.simpleString()))
    return out.withColumn("variance", F.when(~F.isnan("variance"), F.col("variance"))).withColumnRenamed("seq", order)


class MomentsEstimator(Transformer):
    """Count, mean and sample variance of each feature (variance is null below two samples).

    output="running": after every event of a key; "final": one row per key and feature; "merged": over all keys. On
    streams "final" and "merged" are aggregations for complete or update mode. partitions: keys for events without one.
    """

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "output": "running", "partitions": None}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        df = keyed(df, p)
        require(df, p["key"], p["order"], "slice", "data", operator="MomentsEstimator")
        rows = per_feature(df, [p["key"]], keep=(p["order"],))
        if p["output"] == "running":
            return _stream_running(rows, p["key"], p["order"], False) if df.isStreaming else self._running(rows, p["key"], p["order"])
        # partial sums of tasks are merged as models are: by counts, means and squared deviations
        keys = [p["key"], "feature"] if p["output"] == "final" else ["feature"]
        return rows.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))

    @staticmethod
    def _running(rows: DataFrame, key: str, order: str) -> DataFrame:
        # sums of squares are taken around each feature's mean: no cancellation
        centre = rows.groupBy(key, "feature").agg(F.avg("x").alias("c"))
        centred = rows.join(centre.withColumnsRenamed({key: "__key", "feature": "__f"}), F.col(key).eqNullSafe(F.col("__key")) & (F.col("feature") == F.col("__f"))).drop("__key", "__f")
        d = F.col("x") - F.col("c")
        out = running(centred, [key, "feature"], [order], {"n": F.lit(1).cast("bigint"), "s1": d, "s2": d * d})
        variance = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))
        return out.select(key, order, "feature", "n", (F.col("c") + F.col("s1") / F.col("n")).alias("mean"), variance.alias("variance"))


def merge_moments(models: DataFrame) -> DataFrame:
    """Moments (feature, n, mean, m2) of any number of models, as one model per feature with its variance."""
    n, nm = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    whole = models.groupBy("feature").agg(n.alias("n"), (nm / n).alias("mean"))
    parts = models.select("feature", F.col("n").alias("k"), F.col("mean").alias("m"), "m2").join(whole, "feature")
    d = F.col("m") - F.col("mean")
    out = parts.groupBy("feature", "n", "mean").agg((F.sum("m2") + F.sum(F.col("k") * d * d)).alias("m2"))
    return out.select("feature", "n", "mean", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).alias("variance"))


class WeightedMomentsEstimator(Transformer):
    """Total weight, weighted mean and population variance of each feature; outputs as in MomentsEstimator.

    On streams "final" and "merged" take variances from plain sums of squares, as a second pass is not possible.
    """

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "output": "running", "partitions": None}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        df = keyed(df, p)
        require(df, p["key"], p["order"], "slice", "data", "weight", operator="WeightedMomentsEstimator")
        key = p["key"]
        rows = per_feature(df, [key], weighted=True, keep=(p["order"],))
        w, x = F.col("w"), F.col("x")
        if p["output"] == "running" and df.isStreaming:
            return _stream_running(rows, key, p["order"], True)
        if p["output"] == "running":
            centre = rows.groupBy(key, "feature").agg((F.sum(w * x) / F.sum(w)).alias("c")).withColumnsRenamed({key: "__key", "feature": "__f"})
            rows = rows.join(centre, F.col(key).eqNullSafe(F.col("__key")) & (F.col("feature") == F.col("__f"))).drop("__key", "__f")
            d = x - F.col("c")
            out = running(rows, [key, "feature"], [p["order"]], {"n": F.lit(1).cast("bigint"), "weight": w, "s1": w * d, "s2": w * d * d})
            m = F.col("s1") / F.col("weight")
            return out.select(key, p["order"], "feature", "n", "weight", (F.col("c") + m).alias("mean"), F.greatest(F.lit(0.0), F.col("s2") / F.col("weight") - m * m).alias("variance"))
        keys = [key, "feature"] if p["output"] == "final" else ["feature"]
        if df.isStreaming:
            m = F.sum(w * x) / F.sum(w)
            return rows.groupBy(*keys).agg(m.alias("mean"), F.count("x").alias("n"), F.sum(w).alias("weight"), F.greatest(F.lit(0.0), F.sum(w * x * x) / F.sum(w) - m * m).alias("variance"))
        means = rows.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("mean"))
        both = rows.join(means.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        d = x - F.col("mean")
        return both.groupBy(*keys, "mean").agg(F.count("x").alias("n"), F.sum(w).alias("weight"), (F.sum(w * d * d) / F.sum(w)).alias("variance"))


def merge_weighted(models: DataFrame) -> DataFrame:
    """Weighted moments (feature, n, weight, mean, m2) of any number of models as one per feature."""
    w, m = F.col("weight"), F.col("mean")
    s = models.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(w).alias("weight"), F.sum(w * m).alias("wm"), F.sum(w * m * m).alias("wmm"), F.sum("m2").alias("m2"))
    whole = F.col("weight")
    return s.select("feature", "n", "weight", (F.col("wm") / whole).alias("mean"), ((F.col("m2") + F.col("wmm") - F.col("wm") * F.col("wm") / whole) / whole).alias("variance"))


def recurrence(decay: float, inputs: np.ndarray, start: float) -> np.ndarray:
    """y_t = decay * y_(t-1) + inputs_t, in blocks short enough for powers of decay not to leave the range."""
    out = np.empty(len(inputs))
    size = 256 if decay in (0.0, 1.0) else max(1, min(256, int(300 / -np.log(decay))))
    for a in range(0, len(inputs), size):
        u = inputs[a : a + size]
        if decay == 0.0:
            y = u
        else:
            power = decay ** np.arange(1, len(u) + 1)
            y = power * (start + np.cumsum(u / power))
        out[a : a + size] = y
        start = float(y[-1])
    return out


class _Exponential(Fold):
    schema = "seq bigint, feature int, n bigint, mean double, variance double"

    def __init__(self, alpha: float):
        self.alpha = alpha

    def start(self):
        return {}

    def block(self, state, rows: pd.DataFrame):
        a, parts = self.alpha, []
        for f, g in rows.groupby("feature", sort=False):
            n, mean, m2 = state.get(int(f), (0, 0.0, 0.0))
            x = g["x"].to_numpy("f8")
            means = recurrence(a, (1 - a) * x, mean)
            before = np.concatenate([[mean], means[:-1]])
            var = recurrence(1 - a, a * (x - before) * (x - means), m2)
            parts.append(pd.DataFrame({"seq": g["seq"].to_numpy("i8"), "feature": np.int32(f), "n": np.arange(n + 1, n + 1 + len(x)), "mean": means, "variance": var}))
            state[int(f)] = (n + len(x), float(means[-1]), float(var[-1]))
        return state, pd.concat(parts)


class ExponentialMomentsEstimator(Transformer):
    """mean = alpha * mean + (1 - alpha) * x; variance = (1 - alpha) * variance + alpha * (x - old mean) * (x - mean);
    both start at 0 before the first event. alpha outside (0, 1) is refused."""

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "alpha": 0.8, "partitions": None}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        df = keyed(df, p).withColumn("seq", F.col(p["order"]))
        require(df, p["key"], "seq", "slice", "data", operator="ExponentialMomentsEstimator")
        how = exponential(p["alpha"])
        rows = per_feature(df, [p["key"]])
        if df.isStreaming:
            return stream_fold(rows, [p["key"]], ["seq"], how)
        return fold(rows, [p["key"]], ["seq"], how)


def exponential(alpha: float) -> Fold:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    return _Exponential(alpha)


class MovingMomentsEstimator(Transformer):
    """Mean and population variance in sliding windows of event time; a stream needs `late`, its watermark."""

    defaults: dict[str, Any] = {"key": "pid", "time": "ts", "length": "30 milliseconds", "slide": "10 milliseconds", "late": None}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        require(df, p["key"], p["time"], "slice", "data", operator="MovingMomentsEstimator")
        if df.isStreaming:  # watermarks need a timestamp with a zone
            df = df.withColumn(p["time"], F.col(p["time"]).cast("timestamp")).withWatermark(p["time"], p["late"] or "0 seconds")
        rows = per_feature(df, [p["key"]], keep=(p["time"],))
        out = rows.groupBy(F.window(p["time"], p["length"], p["slide"]), p["key"], "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
        return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), p["key"], "feature", "n", "mean", "variance")
