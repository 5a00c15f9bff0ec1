"""Line deduplication (DataFrame operations only).

Method: the 128-bit hash of every line's key is dealt out by range over (hash, document) with a secondary sort by
document and position, so one very common line is spread over many tasks. Each task streams its sorted run, in which
the first occurrence of a line in a document is plain, and is written once. Sums of these runs (a row for each task
and hash) meet in a second exchange, which knows for each hash the number of documents and its first occurrence. The
hashes that drop lines go back to the runs: broadcast if there are few, else joined by (run, hash), so that a common
line stays spread over its runs. What comes back is a run-length coded keep bitmap per document, never text.

Defined results: a null text counts as empty and has one empty line; a key shorter than `min_chars` never drops.
A document is a distinct (doc_id, text): repeated rows count once and each of them gets the same bitmap; null
doc_ids compare as equal. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, hash_pair, let, staged

#: Most common lines (32 to 64 bytes each) that are broadcast; beyond it they are joined by an exchange.
MAX_BROADCAST_LINES = 500_000


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _keys(text: Column) -> Column:
    """Keys of a text's lines: ASCII letters lower-cased, white space stripped at both ends."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.split(low, "\n", -1), lambda line: F.btrim(line, F.lit(WS)))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Lengths of alternating runs of kept and dropped lines, from sorted dropped positions; the first run is kept."""

    def build(d: Column) -> Column:
        starts = F.filter(d, lambda x, i: (i == 0) | (F.coalesce(F.get(d, i - 1), F.lit(-9)) != x - 1))
        ends = F.filter(d, lambda x, i: F.coalesce(F.get(d, i + 1), F.lit(-9)) != x + 1)
        return let(starts, lambda s: let(ends, lambda e: F.concat(
            F.flatten(F.transform(s, lambda x, i: F.array(x - F.coalesce(F.get(e, i - 1) + 1, F.lit(0)), F.get(e, i) - x + 1))),
            F.array(n_lines - 1 - F.element_at(e, -1)))))

    return F.when(F.size(dropped) > 0, let(dropped, build)).otherwise(F.array(n_lines))


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Per document with a dropped line: doc_id, text_hash, dropped (sorted positions).

    A key found in at least `min_docs` documents loses all its lines, or with `keep_first` all but the first
    occurrence by (doc_id, text_hash, position); then a repeat inside one document also goes.
    """
    t = _text(text)
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.posexplode(_keys(t)).alias("pos", "key"))
    h1, h2 = hash_pair(F.col("key"))
    lines = lines.where(F.char_length("key") >= min_chars).select(h1.alias("h1"), h2.alias("h2"), "doc_id", "text_hash", "pos")
    lines = staged(lines, "line-hashes")  # dealing out by range reads its input twice; the texts are read once
    by_doc = ["h1", "h2", "doc_id", "text_hash"]
    ranged = lines.repartitionByRange(*by_doc).sortWithinPartitions(*by_doc, "pos")
    # the range over by_doc brings a document's equal lines together and in order: no exchange and no sort here
    first_in_doc = F.row_number().over(Window.partitionBy(*by_doc).orderBy("pos")) == 1
    runs = staged(ranged.withColumns({"first": first_in_doc, "run": F.spark_partition_id()}), "line-runs")
    n_docs = F.count_if("first").alias("n_docs")
    if keep_first:
        groups = runs.groupBy("h1", "h2").agg(n_docs, F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("at"))
        common = groups.where((F.col("n_docs") >= min_docs) & (F.col("n") > 1)).select("h1", "h2", "at")
    else:
        common = runs.groupBy("h1", "h2").agg(n_docs).where(F.col("n_docs") >= min_docs).select("h1", "h2")
    common = staged(common, "line-common")
    if common.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES:
        drops = runs.join(F.broadcast(common), ["h1", "h2"])
    else:
        held = runs.select("run", "h1", "h2").distinct().join(common, ["h1", "h2"])
        drops = runs.join(held, ["run", "h1", "h2"])
    if keep_first:
        drops = drops.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("at")))
    # repeated rows of one document bring the same position several times
    return drops.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str, str] = ("n_lines", "n_dropped", "keep_runs"), **how) -> DataFrame:
    """docs with its number of lines, of dropped lines, and the compressed keep bitmap; text is untouched.

    A column of docs that has one of `names` is replaced; other names can be given.
    """
    t = _text(text)
    drops = keep_bitmaps(docs, doc_id=doc_id, text=text, **how).withColumnsRenamed({"doc_id": "__drop_id", "text_hash": "__drop_hash", "dropped": "__dropped"})
    own = docs.withColumn("__text_hash", F.xxhash64(t))
    on = own["__text_hash"].eqNullSafe(drops["__drop_hash"]) & own[doc_id].eqNullSafe(drops["__drop_id"])
    n_lines = F.size(F.split(t, "\n", -1))
    dropped = F.coalesce(F.col("__dropped"), F.array().cast("array<int>"))
    joined = own.join(drops, on, "left")
    values = (n_lines.cast("long"), F.size(dropped).cast("long"), _runs(dropped, n_lines))
    return joined.withColumns(dict(zip(names, values))).drop("__drop_id", "__drop_hash", "__dropped", "__text_hash")


def kept_text(text: Column, keep_runs: Column) -> Column:
    """Text without its dropped lines, decoded from the keep bitmap."""
    t = F.coalesce(text, F.lit(""))
    keep = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = let(keep, lambda k: F.filter(F.split(t, "\n", -1), lambda _, i: F.get(k, i)))
    return F.when(F.size(keep_runs) == 1, t).otherwise(F.array_join(kept, "\n"))
