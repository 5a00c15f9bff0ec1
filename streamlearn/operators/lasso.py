"""Lasso on sensor rows whose labels arrive late, by position: imputation, position mapping, delayed updates."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..base import Predictor, Transformer
from ..plans.fold import Fold
from ..plans.running import last_seen
from ..streaming.state import stream_fold
from .online import Lasso, Prequential, _Prequential, stretches


def flatness_map(rows: DataFrame, labels: DataFrame, *, coil: str = "coil_id", pos: str = "x", row_id: str = "row_id") -> DataFrame:
    """rows with `flatness`: the line through the two labels of the same coil nearest in position.

    rows: coil, row_id, pos; labels: coil, label_no, pos, value. Ties in distance go to the smaller label_no. Two
    nearest labels at one position give the first one's value, a single label gives its own, none gives null.

    The two nearest are among the two before and the two after a position, which one ordered pass over labels and
    rows of a coil finds: no join of all positions with all labels.
    """
    at = labels.select(F.col(coil).alias("__c"), F.col(pos).alias("__p"), "label_no", "value").where("__p is not null")
    # of labels at one position only the first two by number can be among the two nearest
    place = Window.partitionBy("__c", "__p").orderBy("label_no")
    at = at.withColumn("__n", F.row_number().over(place)).where("__n <= 2")
    at = at.groupBy("__c", "__p").agg(F.array_sort(F.collect_list(F.struct("label_no", "value"))).alias("l"))  # two at most
    near = Window.partitionBy("__c").orderBy("__p")
    one = F.struct(F.col("__p").alias("p"), F.col("l").alias("l"))
    at = at.withColumn("one", one)
    at = at.select("__c", "__p", F.array("one", F.lag("one").over(near)).alias("back"), F.array("one", F.lead("one").over(near)).alias("ahead"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema[row_id].dataType).alias("__id"))
    own = rows.select(F.col(coil).alias("__c"), F.col(pos).alias("__p"), F.col(row_id).alias("__id"), F.lit(1).alias("__kind"))
    both = at.unionByName(own, allowMissingColumns=True)
    # one pass in each direction; a frame up to the end would be quadratic, and a coil may span many tasks
    both = both.select("__c", "__p", "__kind", "__id", F.col("back").alias("b"), F.col("ahead").alias("a"))
    both = last_seen(both, ["__c"], ["__p", "__kind"], ["b"])
    found = last_seen(both, ["__c"], [F.desc("__p"), "__kind"], ["a"]).where("__kind = 1 and __p is not null")
    empty = F.array().cast("array<struct<p:double,l:array<struct<label_no:bigint,value:double>>>>")
    places = F.filter(F.concat(F.coalesce(F.col("b"), empty), F.coalesce(F.col("a"), empty)), lambda x: x.isNotNull())
    every = F.flatten(F.transform(places, lambda x: F.transform(x["l"], lambda y: F.struct(F.abs(x["p"] - F.col("__p")).alias("d"), y["label_no"].alias("no"), x["p"].alias("p"), y["value"].alias("v")))))
    ranked = F.array_sort(F.array_distinct(every))
    found = found.withColumn("near", ranked)
    l1, l2 = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    line = l1["v"] + (F.col("__p") - l1["p"]) * (l2["v"] - l1["v"]) / (l2["p"] - l1["p"])
    value = F.when(l1.isNull(), None).when(l2.isNull() | (l1["p"] == l2["p"]), l1["v"]).otherwise(line)
    out = found.select(F.col("__c").alias("__rc"), F.col("__id").alias("__ri"), value.alias("flatness"))
    on = rows[coil].eqNullSafe(out["__rc"]) & rows[row_id].eqNullSafe(out["__ri"])
    return rows.join(out, on, "left").drop("__rc", "__ri")


def impute(rows: DataFrame, features: list[str], *, order: str = "seq", by: list[str] | None = None, default: dict[str, float] | None = None) -> DataFrame:
    """Missing features (NaN or null) become the last value seen by `order`, else their default (0).

    Without `by` the memory is one for all rows.
    """
    default = default or {}
    seen = {f: F.when(F.isnan(F.col(f)) | F.col(f).isNull(), None).otherwise(F.col(f)) for f in features}
    filled = lambda f: F.coalesce(F.col(f), F.lit(float(default.get(f, 0.0))))
    out = last_seen(rows.withColumns(seen), list(by or []), [order], features)
    return out.withColumns({f: filled(f) for f in features})


class LassoDelayed(Transformer):
    """Sensor rows (coil_id, seq, x, features...) and label bundles (coil_id, seq, poses, labels) as one prequential run.

    Features are imputed, each row of a coil gets the label mapped to its position when the coil's bundle comes, and
    the lasso learns all of them in order; predictions are made as rows arrive. Of several bundles of a coil each
    labels the rows that came before it, unless they have waited for more than `expire` units of seq.
    reference_masking keeps only the first feature in updates. initial: a saved model (state), as Prequential's.

    On streams both tables are streams; a micro-batch's events are taken in the order of seq, a row before a bundle.
    """

    defaults: dict[str, Any] = {"features": (), "alpha": 1.0, "beta": 0.0, "gamma": 1.0, "impute_by": None, "default": None, "reference_masking": False, "bundles": None, "expire": None, "initial": None}

    def log(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        names = list(p["features"])
        rows = impute(df, names, by=[p["impute_by"]] if p["impute_by"] else None, default=p["default"])
        rows = rows.select("coil_id", F.col("seq").alias("row_id"), "x", F.array(*[F.col(f).cast("double") for f in names]).alias("features"))
        late = p["bundles"].select("coil_id", F.col("seq").alias("at"), F.posexplode(F.arrays_zip("poses", "labels")).alias("label_no", "z"))
        late = late.select(F.struct("coil_id", "at").alias("bundle"), F.col("label_no").cast("bigint").alias("label_no"), F.col("z.poses").alias("x"), F.col("z.labels").alias("value"))
        bundles = late.select("bundle").distinct()
        theirs = rows.join(bundles.select("bundle", F.col("bundle.coil_id").alias("__c")), (F.col("coil_id") == F.col("__c")) & (F.col("row_id") < F.col("bundle.at"))).drop("__c")
        if p["expire"] is not None:
            theirs = theirs.where(F.col("row_id") >= F.col("bundle.at") - p["expire"])
        mapped = flatness_map(theirs, late, coil="bundle", pos="x", row_id="row_id")
        x = F.transform("features", lambda v, i: F.when(i == 0, v).otherwise(F.lit(0.0))) if p["reference_masking"] else F.col("features")
        # order: by arrival; the rows of a bundle follow each other at its arrival
        seen = rows.select(F.lit(0).alias("model_key"), F.col("row_id").alias("arrival"), F.lit(-1).cast("bigint").alias("sub"), F.lit("x").alias("kind"), F.col("row_id").alias("idx"), "features", F.lit(None).cast("double").alias("label"))
        told = mapped.where("flatness is not null").select(F.lit(0).alias("model_key"), F.col("bundle.at").alias("arrival"), F.col("row_id").alias("sub"), F.lit("y").alias("kind"), F.col("row_id").alias("idx"), x.alias("features"), F.col("flatness").alias("label"))
        return seen.unionByName(told)

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        learner, names = Lasso(p["alpha"], p["beta"], p["gamma"]), list(p["features"])
        if df.isStreaming:
            by = p["impute_by"]
            rows = df.select(F.lit(0).alias("model_key"), "coil_id", "seq", F.lit(0).alias("late"), F.col("x").cast("double").alias("x"), F.array(*[F.col(f).cast("double") for f in names]).alias("features"), (F.col(by) if by else F.lit(None)).cast("string").alias("memory"))
            told = p["bundles"].select(F.lit(0).alias("model_key"), "coil_id", "seq", F.lit(1).alias("late"), "poses", "labels")
            return stream_fold(rows.unionByName(told, allowMissingColumns=True), ["model_key"], ["seq", "late", "coil_id"], _Delayed(learner, names, p), with_state=True)
        log = self.log(df, p).withColumn("seq", F.col("arrival"))
        initial = p["initial"] if p["initial"] is None else p["initial"].select(F.lit(0).alias("model_key"), "state")
        return stretches(log, ["arrival", "sub"], learner, len(names), initial)


def interpolated(x: float, poses: list[float], labels: list[float]) -> float | None:
    """The line through the two labels nearest to x; ties go to the earlier one."""
    near = sorted((abs(x - p), n) for n, p in enumerate(poses) if p is not None)[:2]
    if not near:
        return None
    (_, a), b = near[0], near[-1][1]
    if labels[a] is None or labels[b] is None or poses[a] == poses[b]:
        return labels[a]
    return labels[a] + (x - poses[a]) * (labels[b] - labels[a]) / (poses[b] - poses[a])


class _Delayed(Fold):
    """Rows and bundles of a stream: the model, the last value of each feature, and the rows of each coil that wait."""

    schema = _Prequential.schema

    def __init__(self, learner: Lasso, names: list[str], p: dict[str, Any]):
        self.learner, self.n, self.expire, self.masked = learner, len(names), p["expire"], p["reference_masking"]
        self.default = [float((p["default"] or {}).get(f, 0.0)) for f in names]
        self.initial = None if p["initial"] is None else list(p["initial"].first().state)  # one model

    def start(self):
        model = self.learner.start(self.n) if self.initial is None else self.learner.load(self.initial, self.n)
        return {"model": model, "seq": -1, "memory": {}, "waiting": {}}

    def block(self, state, rows: pd.DataFrame):
        out = []
        for coil, seq, late, x, features, memory, poses, labels in zip(*(rows[c] for c in ("coil_id", "seq", "late", "x", "features", "memory", "poses", "labels"))):
            waiting = state["waiting"].setdefault(coil, [])
            if not late:
                last = state["memory"].setdefault(memory, list(self.default))
                for k, v in enumerate(features):
                    if v is not None and v == v:
                        last[k] = v
                own = np.array(last, "f8")
                out.append((seq, self.learner.predict(state["model"], own)))
                waiting.append((seq, x, own))
            else:
                for _, at, own in sorted((w for w in waiting if w[0] < seq and (self.expire is None or w[0] >= seq - self.expire)), key=lambda w: w[0]):
                    y = None if at is None else interpolated(at, list(poses), list(labels))
                    if y is not None:
                        own = np.concatenate([own[:1], np.zeros(self.n - 1)]) if self.masked else own
                        state["model"] = self.learner.update(state["model"], own, y, 0)
            state["seq"] = int(seq)
        if self.expire is not None:
            left = {c: [w for w in held if w[0] >= state["seq"] - self.expire] for c, held in state["waiting"].items()}
            state["waiting"] = {c: held for c, held in left.items() if held}
        seq, p = ([r[k] for r in out] for k in range(2))
        return state, pd.DataFrame({"kind": "prediction", "seq": seq, "idx": seq, "prediction": p, "model": None, "state": None}) if out else None

    def finish(self, state):
        return _Prequential(self.learner, self.n).finish((state["model"], state["seq"]))


class LassoConstant(Predictor):
    """The batch form: fit does nothing and every prediction is 0."""

    def _predict(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        return df.withColumn("prediction", F.lit(0.0))


__all__ = ["LassoConstant", "LassoDelayed", "Prequential", "flatness_map", "impute"]
