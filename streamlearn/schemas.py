"""Schemas of the inputs, checked where an operator is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require(df: DataFrame, *columns: str, operator: str) -> None:
    """Columns that must be there; operators accept more columns and other orders."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{operator} needs the columns {', '.join(columns)}; {', '.join(missing)} missing among {', '.join(df.columns)}")
