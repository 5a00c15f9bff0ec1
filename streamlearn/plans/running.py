"""Running sums and row numbers in a total order, without one task per key.

A window over a key runs in one task, which a hot key makes the bottleneck. Here rows are dealt by range over
(keys, order), so a key spans as many tasks as its rows need. Each task sums its own stretch; what came before is
added from the totals of the (task, key) pairs, a table with a row for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """df with a column for each of sums: the sum of its value over all rows of the same keys up to this one."""
    values = {f"__v_{n}": (F.col(v) if isinstance(v, str) else v) for n, v in sums.items()}
    # values by name, then the order's ties: equal rows may take either place
    ranged = df.withColumns(values).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = staged(ranged.withColumn("__run_at", F.monotonically_increasing_id()), "running").withColumn("__run_no", F.call_function("shiftright", "__run_at", F.lit(33)))
    own = Window.partitionBy("__run_no", *keys).orderBy("__run_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"__v_{n}": F.sum(f"__v_{n}").over(own) for n in sums})
    totals = placed.groupBy("__run_no", *keys).agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__run_no").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumns({f"__b_{n}": F.sum(f"__b_{n}").over(earlier) for n in sums})
    before = before.select(F.col("__run_no").alias("__run_part"), *[F.col(k).alias(f"__run_key_{k}") for k in keys], *[f"__b_{n}" for n in sums])
    on = local["__run_no"] == before["__run_part"]
    for k in keys:
        on = on & local[k].eqNullSafe(before[f"__run_key_{k}"])
    out = local.join(before, on, "left")
    out = out.withColumns({n: F.when(F.col(f"__v_{n}").isNull() & F.col(f"__b_{n}").isNull(), None).otherwise(F.coalesce(f"__v_{n}", F.lit(0)) + F.coalesce(f"__b_{n}", F.lit(0))) for n in sums})
    return out.select(*df.columns, *sums)


def last_seen(df: DataFrame, keys: list[str], order: list[Column | str], columns: list[str]) -> DataFrame:
    """df with each of columns replaced by its last non-null value in the rows of the same keys up to this one.

    The same plan as running(): tasks fill their own stretch, and what is still open at its beginning comes from the
    last values of the stretches before it, a row for each task and key.
    """
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    placed = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__run_at", F.monotonically_increasing_id()), "last-seen").withColumn("__run_no", F.call_function("shiftright", "__run_at", F.lit(33)))
    own = Window.partitionBy("__run_no", *keys).orderBy("__run_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in columns})
    ends = placed.groupBy("__run_no", *keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__run_at"))).alias(f"__run_last_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("__run_no").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("__run_no").alias("__run_part"), *[F.col(k).alias(f"__run_key_{k}") for k in keys], *[F.last(f"__run_last_{c}", ignorenulls=True).over(earlier).alias(f"__run_last_{c}") for c in columns])
    on = local["__run_no"] == before["__run_part"]
    for k in keys:
        on = on & local[k].eqNullSafe(before[f"__run_key_{k}"])
    return local.join(before, on, "left").withColumns({c: F.coalesce(c, f"__run_last_{c}") for c in columns}).select(df.columns)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """df with the number of each row within its keys, from 1."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")})
