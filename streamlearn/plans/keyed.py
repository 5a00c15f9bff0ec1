"""Keys for events that come without one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """df with the column p["key"]; where it is missing and p["partitions"] is given, events are dealt to so many keys by
    a hash of p["order"], the same in every run."""
    if p["key"] in df.columns or not p["partitions"]:
        return df
    return df.withColumn(p["key"], F.pmod(F.xxhash64(p["order"]), F.lit(p["partitions"])))
