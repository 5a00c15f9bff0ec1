"""Helpers shared by the corpus operators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import shared_dir, staged

__all__ = ["SECOND_SEED", "WS", "WS_CLASS", "Coded", "Taken", "bit_table", "hash_pair", "let", "map_arrow", "read", "sampled", "shared_dir", "spread_join", "staged", "training_texts"]

#: The white space that separates words, as a Python string and inside a regex class.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"\x20\x09-\x0D"
#: Mixed in front of a value to get a second, independent 64-bit hash of it.
SECOND_SEED = 0x5DEECE66D
#: Bytes of an Arrow batch, unless the session says otherwise: a batch is held by the JVM and by Python at once.
BATCH_BYTES = 4 << 20
#: A key is hot if it has more than one of so many rows; there are at most as many hot keys.
HOT_SHARE = 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times in body (lambda variables are bound, columns would be inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_pair(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together a 128-bit identity of a string."""
    return F.xxhash64(value), F.xxhash64(F.lit(SECOND_SEED), value)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow in batches that stay small however long the texts are (a batch holds one row at least).

    The limit is a setting of the session, so it is set there, where the session does not set it itself.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _chance(*key: Column) -> Column:
    """A number from 0 to 2^30 - 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(SECOND_SEED), *key), F.lit(1 << 30))


def sampled(docs: DataFrame, rows: int, *key: str) -> DataFrame:
    """About `rows` rows of docs (all, if there are no more), chosen by a hash of key; nothing is sorted or sent around."""
    total = docs.count()
    share = min(1.0, rows / total) if total else 1.0
    return docs.where(_chance(*map(F.col, key)) < int(share * (1 << 30)))


def training_texts(docs: DataFrame, doc_id: str, text: str, *, rows: int, chars: int, holding: str | None = None) -> list[str]:
    """Whole texts of a sample of at most `rows` different documents (doc_id, text) and `chars` characters in all.

    Documents are taken in the order of a hash of doc_id (of the text, where that is null); one that does not fit into
    what is left of `chars` is passed over, as is what does not hold the pattern. Repeated rows count once, whatever their number; sorted by text.
    """
    i, t = F.col(doc_id), F.col(text)
    total = docs.count()
    share = min(1.0, 1.2 * rows / total) if total else 1.0
    # the text is read and hashed only where there is no doc_id, and for what is chosen
    chance = F.when(i.isNotNull(), _chance(i)).otherwise(_chance(t))
    some = docs.where(chance < int(share * (1 << 30))).where(t.isNotNull()).select(chance.alias("c"), F.xxhash64(i, t).alias("h"), t.alias("t"))
    some = some.where(F.col("t").rlike(holding)) if holding else some
    order = some.groupBy("c", "h").agg(F.max(F.char_length("t")).alias("n")).orderBy("c", "h").limit(rows).collect()
    chosen, left = [], chars
    for r in order:
        if r.n <= left:
            chosen.append(r.h)
            left -= r.n
    if not chosen:
        return []
    return sorted(r.t for r in some.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).select("t").collect())


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows left-joined with table (a row for each key; keys are not null), without a task that gets all rows of a hot key.

    The column n of table is the number of rows with its key, or an upper bound of it. Hot keys, at most HOT_SHARE of
    them, are broadcast; rows that have found theirs go on under a key of their own. table is read three times and should
    be written.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    values = [c for c in table.columns if c != key]
    hot, given = F.col(n) * HOT_SHARE > total, F.struct(*values)
    few = F.broadcast(table.where(hot).select(key, given.alias("__hot")))
    far = table.where(~hot).select(F.col(key).alias("__key"), F.lit(0).alias("__zero"), given.alias("__cold"))
    one = rows.join(few, key, "left").withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("int")))
    out = one.join(far, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left")
    found = F.coalesce("__hot", "__cold")
    return out.select(*rows.columns, *[found[c].alias(c) for c in values])


def bit_table(positions: DataFrame, bits: int):
    """A table of `bits` bits (in words of 64) in which those of the column `bit` are set; its size is fixed by `bits`."""
    import numpy as np

    word, bit = F.call_function("shiftright", "bit", F.lit(6)), F.pmod("bit", F.lit(64)).cast("int")
    words = positions.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    got = words.toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, "i8")
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table


class Taken:
    """Which stretches of a text are taken by spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a


class Coded(dict):
    """Codes of strings, made once each by `made` (below 2^64) and kept; bounded by `keep`.

    Looking strings up by the mapping itself learns the unknown ones, so a block of tokens is one C-speed pass.
    """

    def __init__(self, made: Callable[[str], int], keep: int):
        super().__init__()
        self.made, self.keep = made, keep

    def __missing__(self, token: str) -> int:
        code = self[token] = self.made(token)
        return code

    def of(self, tokens: Iterable[str], n: int):
        """An array of the n tokens' codes."""
        import numpy as np

        if len(self) > self.keep:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), "u8", n)
