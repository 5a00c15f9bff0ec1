"""Confusion matrices and their metrics, running or final, and the matching of predictions with labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fold import Fold
from ..plans.running import running
from ..streaming.state import stream_fold

CELLS = ("tp", "fp", "tn", "fn")


def outcomes(predicted: Column, label: Column) -> dict[str, Column]:
    """Indicator of each cell: a prediction above 0 is positive, a label above 0 is positive, below 0 negative."""
    yes = F.coalesce(predicted > 0, F.lit(False))
    return {
        "tp": (yes & (label > 0)).cast("bigint"),
        "fp": (yes & ~(label > 0)).cast("bigint"),
        "tn": (~yes & (label < 0)).cast("bigint"),
        "fn": (~yes & ~(label < 0)).cast("bigint"),
    }


def metrics(beta: float = 1.0, reference_metrics: bool = False) -> dict[str, Column]:
    """Metrics from columns tp, fp, tn, fn. Empty denominators give accuracy 0, precision 1, recall 0, fpr 0, f 0.

    reference_metrics=True swaps the false counts, as some reports do: both precision and recall are then tp / (tp + fp).
    """
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn")}
    if reference_metrics:
        c["fp"], c["fn"] = c["fn"], c["fp"]

    def ratio(a: Column, b: Column, empty: float) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(empty))

    every = c["tp"] + c["fp"] + c["tn"] + c["fn"]
    hit = c["fn"] if reference_metrics else c["fp"]
    precision = ratio(c["tp"], c["tp"] + hit, 1.0)
    recall = precision if reference_metrics else ratio(c["tp"], c["tp"] + c["fn"], 0.0)
    fpr = ratio(c["fn"] if reference_metrics else c["fp"], (c["fn"] if reference_metrics else c["fp"]) + c["tn"], 0.0)
    b2 = beta * beta
    return {
        "accuracy": ratio(c["tp"] + c["tn"], every, 0.0),
        "precision": precision,
        "recall": recall,
        "fpr": fpr,
        "f": ratio((1 + b2) * precision * recall, b2 * precision + recall, 0.0),
    }


def confusion(df: DataFrame, predicted: str = "prediction", label: str = "label", keys: list[str] | None = None, **how) -> DataFrame:
    """Counts and metrics of all rows of each key."""
    cells = outcomes(F.col(predicted), F.col(label))
    out = df.groupBy(*(keys or [])).agg(*[F.sum(v).alias(k) for k, v in cells.items()])
    return out.withColumns(metrics(**how))


class _Counted(Fold):
    """Rows with running sums of their columns of CELLS, for streams."""

    def __init__(self, schema: str):
        self.schema = schema

    def start(self):
        return [0] * len(CELLS)

    def block(self, state, rows: pd.DataFrame):
        sums = rows[list(CELLS)].fillna(0).cumsum() + state
        return [int(x) for x in sums.iloc[-1]], rows.assign(**{c: sums[c] for c in CELLS})


def running_confusion(df: DataFrame, keys: list[str], order: list[str], predicted: str = "prediction", label: str = "label", **how) -> DataFrame:
    """df with the counts and metrics up to each row; a row without a label counts nowhere."""
    if df.isStreaming:
        cells = df.withColumns(outcomes(F.col(predicted), F.col(label)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name not in keys)
        return stream_fold(cells, keys, order, _Counted(schema)).select(cells.columns).withColumns(metrics(**how))
    return running(df, keys, order, outcomes(F.col(predicted), F.col(label))).withColumns(metrics(**how))


def match(predictions: DataFrame, labels: DataFrame, on: list[str], *, late: tuple[str, str, str] | None = None) -> DataFrame:
    """Predictions joined with their labels. For streams, late = (prediction time, label time, interval): the
    watermark of both sides and the longest wait for a label."""
    if late is None:
        return predictions.join(labels, on)
    mine, theirs, wait = late
    right = labels.withWatermark(theirs, wait).withColumnsRenamed({c: f"__{c}" for c in on})
    cond = F.expr(f"{theirs} >= {mine} AND {theirs} <= {mine} + INTERVAL {wait}")
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    return predictions.withWatermark(mine, wait).join(right, cond).drop(*[f"__{c}" for c in on])
