"""Minimax contiguous partition of documents into shards of near equal bytes (DataFrame operations only).

Method: documents with equal texts form atomic groups, ordered by the 128-bit hash of the text. The smallest feasible
shard capacity is found by binary search, each capacity checked greedily, and the order is cut there. Groups so large
that they fill a shard's fair share alone (fewer than the shards there are) get shards of their own first.

The search never needs all groups on the driver. It starts from sums over at most 2^17 blocks of the hash order. With
blocks as atoms it gives an upper bound of the capacity, and every cut of a feasible partition then lies in one of
the windows [total - (K - k) * upper, k * upper]; only the blocks in those windows are summed again, finer, until the
windows hold at most 2^17 groups, which are read exactly. Blocks outside the windows cannot hold a cut, so the
capacity found is that of all groups. Between feasible cuts the ones nearest to an even division are taken.

Defined results: a null text counts as empty (16 bytes), and so equals an empty one; null and repeated doc_ids are
ordinary rows and ties in any order get distinct slots. Fewer groups than shards leave shards empty. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_pair, staged

#: Most block sums or groups read by the driver at once.
MAX_ITEMS = 1 << 17
#: Bytes a document takes besides its text.
ROW_BYTES = 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Item:
    """A block or a group of the order: its first key and its bytes."""

    key: tuple[int, int]
    size: int


def greedy_cuts(ends: list[int], capacity: int) -> list[int]:
    """Numbers of items before each cut when every shard takes as much as it can. ends: running sums of sizes."""
    cuts, done = [], 0
    while done < len(ends):
        base = ends[done - 1] if done else 0
        done = bisect_right(ends, base + capacity, done)
        cuts.append(done)
    return cuts[:-1]


def smallest_capacity(ends: list[int], largest: int, shards: int) -> int:
    low, high = max(largest, -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(ends, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts of a partition into at most `shards` parts within capacity, each as near to an even division as it can be."""
    total, latest, at = ends[-1], [], len(ends)
    for _ in range(shards - 1):  # from the right: the earliest cut that leaves the rest feasible
        floor = (ends[at - 1] if at else 0) - capacity
        at = bisect_left(ends, floor) + 1 if floor > 0 else 0
        latest.append(at)
    earliest, cuts, done = latest[::-1], [], 0
    for k in range(shards - 1):
        base = ends[done - 1] if done else 0
        most = bisect_right(ends, base + capacity, done)
        target = base + (total - base) / (shards - k)
        near = bisect_left(ends, target, done)
        options = [c for c in (near, near + 1) if c <= len(ends)]
        best = min(options, key=lambda c: abs((ends[c - 1] if c else 0) - target))
        done = max(min(best, most), earliest[k], done)
        cuts.append(done)
    return cuts


def _running(items: list[Item]) -> list[int]:
    ends, total = [], 0
    for x in items:
        total += x.size
        ends.append(total)
    return ends


def find_cuts(groups: DataFrame, shards: int, without: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Keys at which shards 1, 2, ... of the ordered groups begin. groups: h1, h2, bytes."""
    rest = groups
    if without:
        rest = rest.where(~reduce(Column.__or__, [(F.col("h1") == a) & (F.col("h2") == b) for a, b in without]))
    top = rest.agg(F.max("bytes"), F.count(F.lit(1))).first()
    if not top[1] or shards < 2:
        return []
    windows, fixed, count, share = [(_LOW, _HIGH)], [], top[1], 1.0
    while True:
        inside = rest.where(reduce(Column.__or__, [F.col("h1").between(a, b) for a, b in windows]))
        exact = count <= MAX_ITEMS
        if exact:
            found = [Item((r[0], r[1]), r[2]) for r in inside.select("h1", "h2", "bytes").collect()]
        else:
            bits = 1
            while bits < 63 and 2 ** (bits + 1) * share + 2 * len(windows) <= MAX_ITEMS:
                bits += 1
            block = F.call_function("shiftright", F.col("h1"), F.lit(64 - bits))
            sums = inside.groupBy(block.alias("block")).agg(F.sum("bytes"), F.count(F.lit(1))).collect()
            counts = {r[0] << (64 - bits): r[2] for r in sums}
            found = [Item((r[0] << (64 - bits), _LOW), r[1]) for r in sums]
        items = sorted(fixed + found, key=lambda x: x.key)
        ends = _running(items)
        capacity = smallest_capacity(ends, max(x.size for x in items), shards)
        if exact:
            return [items[c].key if c < len(items) else (_HIGH, _HIGH) for c in even_cuts(ends, capacity, shards)]
        width = 1 << (64 - bits)
        hit = set()
        for k in range(1, shards):
            low, high = ends[-1] - (shards - k) * capacity, k * capacity
            hit.update(range(max(0, bisect_left(ends, low)), min(len(items), bisect_right(ends, high) + 1)))
        own = {x.key: x for x in found}
        chosen = [items[i].key[0] for i in sorted(hit) if items[i].key in own]
        fixed = [x for i, x in enumerate(items) if i not in hit or x.key not in own]
        if not chosen or width == 1:
            return [items[c].key if c < len(items) else (_HIGH, _HIGH) for c in even_cuts(ends, capacity, shards)]
        windows = []
        for key in chosen:
            if windows and windows[-1][1] + 1 == key:
                windows[-1] = (windows[-1][0], key + width - 1)
            else:
                windows.append((key, key + width - 1))
        count, share = sum(counts[k] for k in chosen), len(chosen) * width / 2**64


def giants(top: list[tuple[tuple[int, int], int]], total: int, shards: int) -> list[tuple[int, int]]:
    """Keys of the groups, largest first, that fill the fair share of what remains."""
    out = []
    for key, size in top:
        left = shards - len(out)
        if left < 2 or size * left < total:
            break
        out.append(key)
        total -= size
    return out


def shard_documents(docs: DataFrame, *, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    h1, h2 = hash_pair(t)
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), h1.alias("h1"), h2.alias("h2")), "shard-rows")
    groups = staged(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = [((r[0], r[1]), r[2]) for r in groups.orderBy(F.desc("bytes"), "h1", "h2").limit(shards).collect()]  # as many as shards
    alone = giants(top, total, shards)
    cuts = find_cuts(groups, shards - len(alone), alone)

    after = lambda a, b: (F.col("h1") > a) | ((F.col("h1") == a) & (F.col("h2") >= b))
    shard = reduce(Column.__add__, [F.when(after(a, b), 1).otherwise(0) for a, b in cuts], F.lit(len(alone)))
    for i, (a, b) in enumerate(alone):
        shard = F.when((F.col("h1") == a) & (F.col("h2") == b), i).otherwise(shard)
    order = ["shard", "h1", "h2", "doc_id"]
    # dealt by range over the whole order, so a large shard or group is many tasks' work; written, so numbers stay
    ranged = rows.withColumn("shard", shard.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    runs = placed.groupBy(part.alias("part"), "shard").agg(F.min("at"), F.count(F.lit(1))).collect()  # a row for each task and shard in it
    bases, used = [], {}
    for p, s, first, n in sorted(runs, key=lambda r: r[0]):
        bases.append((p, s, used.get(s, 0) - first))
        used[s] = used.get(s, 0) + n
    base = F.broadcast(docs.sparkSession.createDataFrame(bases, "part bigint, shard int, base bigint"))
    out = placed.withColumn("part", part).join(base, ["part", "shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("base")).alias("slot"))
