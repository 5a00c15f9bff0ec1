"""Reservoir samples of a keyed stream: simple, weighted, and adaptive in size.

Random numbers are a function of (seed, key, order), so results do not depend on partitioning or retries; a column
of uniforms may be given instead.
"""

from __future__ import annotations

from math import exp, lgamma
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import Transformer
from ..plans.fold import Fold, fold
from ..plans.keyed import keyed
from ..plans.running import numbered
from ..schemas import require
from ..streaming.state import stream_fold


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


class _Acceptance(Fold):
    schema = "seq bigint, slot bigint"

    def __init__(self, k: int):
        self.k = k

    def start(self):
        return 0

    def block(self, state, rows: pd.DataFrame):
        n = state + np.arange(len(rows))
        slot = np.where(n < self.k, n, np.floor(rows["u"].to_numpy("f8") * (n + 1)).astype("i8"))
        out = pd.DataFrame({"seq": rows["seq"].to_numpy("i8"), "slot": slot})
        return state + len(rows), out[slot < self.k]


class SimpleReservoirSampling(Transformer):
    """Algorithm R. Element n (from 0) of a key goes to slot n while n < k, then to slot floor(u * (n + 1)) if that is below k.

    output="log": the accepted elements with their slots; "reservoir": the last element of each slot. A stream always
    gives the log (order and slot of what is accepted), from which any consumer keeps the last of each slot.
    """

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "k": 10, "seed": 0, "uniform": None, "output": "log", "partitions": None}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        key, order, k, df = p["key"], p["order"], p["k"], keyed(df, p)
        require(df, key, order, operator="SimpleReservoirSampling")
        u = F.col(p["uniform"]) if p["uniform"] else uniform(p["seed"], key, order)
        if df.isStreaming:
            rows = df.select(key, F.col(order).alias("seq"), u.alias("u"))
            return stream_fold(rows, [key], ["seq"], _Acceptance(k))
        n = F.col("__rn") - 1
        slot = F.when(n < k, n).otherwise(F.floor(u * (n + 1)))
        log = numbered(df, [key], [order], "__rn").withColumn("slot", slot.cast("bigint")).where(F.col("slot") < k).drop("__rn")
        if p["output"] == "log":
            return log
        # partial aggregation keeps a row for each task, key and slot
        last = log.groupBy(key, "slot").agg(F.max_by(F.struct(*[c for c in log.columns if c not in (key, "slot")]), order).alias("x"))
        return last.select(key, "slot", "x.*")


class _Heaviest(Fold):
    schema = "at bigint, rank int, seq bigint, priority double"

    def __init__(self, k: int):
        self.k = k

    def start(self):
        return None, []

    def block(self, state, rows: pd.DataFrame):
        held = [*state[1], *zip((-rows["priority"]).tolist(), rows["seq"].tolist())]
        return (int(rows["seq"].iloc[-1]), sorted(held)[: self.k]), None

    def finish(self, state):
        at, held = state
        return pd.DataFrame({"at": at, "rank": np.arange(1, len(held) + 1, dtype="i4"), "seq": [s for _, s in held], "priority": [-x for x, _ in held]})


class WeightedReservoirSampling(Transformer):
    """A-Res: the k elements of each key with the largest u ** (1 / weight); the weight is data[0] unless a column is named.

    Elements whose weight is not positive (or null) are never drawn. Ranked within tasks first, so a hot key sends k
    rows from each of them. A stream gives the reservoir of each key it has met after every micro-batch: at (the last
    order seen), rank, seq and priority.
    """

    defaults: dict[str, Any] = {"key": "pid", "order": "seq", "k": 4, "seed": 0, "uniform": None, "weight": None, "partitions": None}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        key, order, df = p["key"], p["order"], keyed(df, p)
        require(df, key, order, operator="WeightedReservoirSampling")
        w = F.col(p["weight"]) if p["weight"] else F.get("data", F.lit(0))
        u = F.col(p["uniform"]) if p["uniform"] else uniform(p["seed"], key, order)
        ranked = df.withColumn("priority", F.when(w > 0, F.pow(u, 1.0 / w))).where("priority is not null")
        if df.isStreaming:
            rows = ranked.select(key, F.col(order).cast("bigint").alias("seq"), "priority")
            return stream_fold(rows, [key], ["seq"], _Heaviest(p["k"]), with_state=True)
        first = Window.partitionBy(key).orderBy(F.desc("priority"), order)
        return ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p["k"])


def uniformity_confidence(i: int, k: int, d: int, m: int) -> float:
    """How uniform a reservoir grown from k to k + d can be, after i elements, if the next m are looked at."""

    def choose(a: int, b: int) -> float:
        return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1) if 0 <= b <= a else float("-inf")

    if k + d > i + m:
        return 0.0
    whole = choose(i + m, k + d)
    return sum(exp(choose(i, x) + choose(m, k + d - x) - whole) for x in range(max(0, k + d - m), min(k, i) + 1))


def least_extra(i: int, k: int, d: int, threshold: float, most: int = 10_000_000) -> int:
    """The least m with a confidence of at least threshold (found by doubling, then halving)."""
    high = max(1, d)
    while uniformity_confidence(i, k, d, high) < threshold:
        high *= 2
        if high > most:
            raise ValueError("threshold cannot be reached")
    low = high // 2
    while low + 1 < high:
        middle = (low + high) // 2
        if uniformity_confidence(i, k, d, middle) >= threshold:
            high = middle
        else:
            low = middle
    return high


def kept_of_old(i: int, m: int, size: int, u: float) -> int:
    """How many of a uniform sample of `size` out of i old and m new elements are old: the hypergeometric law at u."""

    def choose(a: int, b: int) -> float:
        return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1) if 0 <= b <= a else float("-inf")

    x, top = max(0, size - m), min(size, i)
    below = exp(choose(i, x) + choose(m, size - x) - choose(i + m, size))
    while below <= u and x < top:
        x += 1
        below += exp(choose(i, x) + choose(m, size - x) - choose(i + m, size))
    return x


class _Adaptive(Fold):
    schema = "seq bigint, size int, members array<bigint>"

    def __init__(self, k: int, change: int, number_to_change: int, threshold: float, every: bool):
        self.k, self.change, self.at, self.threshold, self.every = k, change, number_to_change * k, threshold, every

    def start(self):
        return {"n": 0, "k": self.k, "held": [], "left": 0, "want": 0, "seq": None}

    def step(self, s: dict[str, Any], seq: int, u: float, v: float) -> None:
        """held: (v, seq) by slot. u decides about slots and how many stay, v about which stay and what fills up."""
        s["n"] += 1
        n = s["n"]
        if n - 1 == self.at and self.change != s["k"]:
            d, keep = self.change - s["k"], self.change
            if d > 0:
                m = least_extra(n - 1, s["k"], d, self.threshold)
                keep = min(max(kept_of_old(n - 1, m, s["k"] + d, u), s["k"] + d - m), len(s["held"]))
                s["left"], s["want"] = m, self.change - keep
            stay = set(sorted(s["held"])[:keep])
            s["held"], s["k"] = [x for x in s["held"] if x in stay], self.change
        held = s["held"]
        if s["left"]:  # selection sampling of `want` among the next `left`
            if v * s["left"] < s["want"]:
                held.append((v, seq))
                s["want"] -= 1
            s["left"] -= 1
        elif len(held) < s["k"]:
            held.append((v, seq))
        elif (j := int(u * n)) < s["k"]:
            held[j] = (v, seq)
        s["seq"] = seq

    def block(self, state, rows: pd.DataFrame):
        out = []
        for seq, u, v in zip(rows["seq"].tolist(), rows["u"].tolist(), rows["v"].tolist()):
            self.step(state, seq, u, v)
            if self.every:
                out.append((seq, state["k"], [x for _, x in state["held"]]))
        return state, pd.DataFrame(out, columns=["seq", "size", "members"]).astype({"size": "int32"}) if out else None

    def finish(self, state):
        return None if self.every else pd.DataFrame({"seq": [state["seq"]], "size": np.array([state["k"]], "i4"), "members": [[x for _, x in state["held"]]]})


class AdaptiveReservoirSampling(Transformer):
    """A reservoir of k that becomes one of `change` after number_to_change * k elements of its key.

    Shrinking keeps a random subset. Growing looks at the least number m of further elements for which the
    uniformity confidence reaches `threshold`, keeps a hypergeometric number of old members and draws the rest from
    those m. output="final" gives the last reservoir of each key, "log" the reservoir after each element.
    `uniform` names two columns of independent uniforms in (0, 1); without it they come from a hash.
    """

    defaults: dict[str, Any] = {"key": "pid", "k": 4, "number_to_change": 2, "threshold": 0.99, "change": 5, "seed": 0, "uniform": None, "output": "final"}

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        require(df, p["key"], "seq", operator="AdaptiveReservoirSampling")
        how = _Adaptive(p["k"], p["change"], p["number_to_change"], p["threshold"], p["output"] == "log")
        u, v = map(F.col, p["uniform"]) if p["uniform"] else (uniform(p["seed"], p["key"], "seq"), uniform(~p["seed"], p["key"], "seq"))
        rows = df.select(p["key"], "seq", u.alias("u"), v.alias("v"))
        if df.isStreaming:
            return stream_fold(rows, [p["key"]], ["seq"], how, with_state=True)
        return fold(rows, [p["key"]], ["seq"], how)
