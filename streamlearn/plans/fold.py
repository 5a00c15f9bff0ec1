"""Ordered folds over keyed rows, in bounded memory, for batches and streams alike.

A Fold has a state per key and sees the key's rows in order, in blocks of any size; it never needs the whole group.
In a batch, rows are hash-partitioned by key and sorted within the partition, and a partition is one pass over
Arrow batches in which only the current key's state is held. In a stream, the same Fold runs per micro-batch with its
state in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold:
    """Subclasses define the output schema (without the key) and these three."""

    schema: str

    def start(self) -> Any:
        raise NotImplementedError

    def block(self, state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame | None]:
        raise NotImplementedError

    def finish(self, state: Any) -> pd.DataFrame | None:
        """Rows that stand for the state at the end of a batch."""
        return None


def key_types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def fold(df: DataFrame, keys: list[str], order: list[str], how: Fold, tasks: int | None = None) -> DataFrame:
    """The rows that `how` returns, with their keys. Rows of one key are seen in the order of `order`.

    tasks: the first key is a number below it and is itself the number of the task.
    """
    names = columns_of(how.schema)

    def tagged(out: pd.DataFrame | None, key: tuple) -> pd.DataFrame | None:
        if out is None or not len(out):
            return None
        out = out[names].copy()
        for n, k in enumerate(keys):
            out.insert(n, k, [key[n]] * len(out))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            if not len(rows):
                continue
            k = rows[keys].astype(object).where(rows[keys].notna(), None)
            edge = (k != k.shift()).any(axis=1) & ~(k.isna() & k.shift().isna()).all(axis=1)
            begins = [0, *[i for i in edge.to_numpy().nonzero()[0].tolist() if i], len(rows)]
            for a, b in zip(begins, begins[1:]):
                own = tuple(k.iloc[a])
                if own != key:
                    if key is not None and (out := tagged(how.finish(state), key)) is not None:
                        yield out
                    key, state = own, how.start()
                state, out = how.block(state, rows.iloc[a:b])
                if (out := tagged(out, key)) is not None:
                    yield out
        if key is not None and (out := tagged(how.finish(state), key)) is not None:
            yield out

    dealt = df.repartition(*[F.col(k) for k in keys]) if tasks is None else df.repartitionById(tasks, F.col(keys[0]).cast("int"))
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, f"{key_types(df, keys)}, {how.schema}")


def columns_of(schema: str) -> list[str]:
    """Names of the columns of a schema string."""
    out, depth, now = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.split()[0].strip("`"))
            now = ""
        else:
            now += c
    return out
