"""Folds over streams: the same Fold that a batch runs, with its state in the state store."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.fold import Fold, columns_of, key_types



def stream_fold(df: DataFrame, keys: list[str], order: list[str], how: Fold, *, with_state: bool = False) -> DataFrame:
    """The rows that `how` returns over a stream, with their keys; rows are ordered within each micro-batch.

    A row that comes in a later micro-batch than rows after it in `order` is folded when it comes.
    with_state: also return the rows of finish() after each micro-batch.
    """
    names = columns_of(how.schema)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else how.start()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        now, out = how.block(now, rows)
        parts = [out, how.finish(now) if with_state else None]
        state.update((pickle.dumps(now),))
        for x in parts:
            if x is not None and len(x):
                x = x[names].copy()
                for n, k in enumerate(keys):
                    x.insert(n, k, [key[n]] * len(x))
                yield x

    return df.groupBy(*keys).applyInPandasWithState(run, f"{key_types(df, keys)}, {how.schema}", "state binary", "append", GroupStateTimeout.NoTimeout)
