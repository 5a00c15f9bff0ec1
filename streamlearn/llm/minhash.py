"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Method: a document's five-word shingles, weighted by how often they occur, arrive as Poisson processes with the
weights as rates. Each arrival falls into a random one of the signature's registers, which keeps its earliest one; a
shingle is done when its next arrival is later than all registers (early termination). Two signatures agree in a
register with the probability Jaccard similarity J_P of the weighted shingle sets, which is the Jaccard similarity J
where no shingle repeats. Bands of registers give buckets of candidates; a candidate is verified exactly and linked
if J_P or J, which only differ where shingles repeat, reaches the threshold.

No bucket emits all its pairs and none is capped. In every bucket the most central member leads (the one that meets
most others over all its buckets, so a family of copies has the same leader everywhere) and first only pairs with a
leader are verified; their links give components. Members of a leader that are still in several components are then
compared with each other without leaving their task: 1 - J_P and 1 - J are metrics, so only members whose distances
to the leader differ by at most 1 - threshold can be similar, and of those only pairs whose signatures, first short
and then long ones, agree in so many registers that a similar pair is missed with a probability under 1e-6, are verified exactly.
A task joins what it links at once and skips pairs already joined, so it returns fewer links than it has members.
Large groups are compared in blocks by many tasks. Joins on buckets, classes and texts spread the rows of hot keys. Classes are the connected components of all links, found with alternating large-star and
small-star steps on distributed tables.

Equal texts are one node (the MD5 of the text) from the start, so copies cost a row each and no pairs.

Defined results: a null text counts as empty; equal texts (empty ones too) are one class; a text with fewer than five
words has one shingle of all its words, one without a word has none and links to nothing. class_id is the least
non-null doc_id of the class (null if there is none); class_key is set always. Repeated rows and ties stay rows of
their own. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SECOND_SEED, WS_CLASS, Coded, bit_table, map_arrow, spread_join, staged

SHINGLE_WORDS = 5
#: bands x rows registers: at a J_P of 0.8 a pair shares no band with probability 5e-8; a high J alone promises nothing.
BANDS, ROWS = 32, 4
#: Pairs verified by one task.
PAIRS_A_TASK = 20_000
#: Shingles of the members of one leader compared by one task with as many others; a member goes to as many tasks as
#: its leader has blocks.
BLOCK_SHINGLES = 500_000
#: Registers of the long signatures, and standard deviations below the threshold that still pass.
LONG, DEVIATIONS = 512, 5.0
#: Most leaders with several components that are broadcast (32 bytes each); beyond it they are joined by an exchange.
MAX_BROADCAST_LEADERS = 500_000
#: Bits of the fixed-size filter of wanted texts (8 MB).
FILTER_BITS = 1 << 26
#: Distances this close to the limit count as within it (rounding).
EPS = 1e-9
_WORDS_KEPT = 200_000


class Shingler:
    """Hashed five-word shingles of texts. Words are separated by white space and compared in lower case and without
    the marks at their ends (a word of marks only is kept), so words that are equal stay equal."""

    def __init__(self):
        import re

        import xxhash

        self.words = re.compile(rf"[^{WS_CLASS}]+").findall
        ends = re.compile(r"^\W+|\W+$")

        def code(word: str) -> int:
            low = word.lower()
            return xxhash.xxh64_intdigest(low if low.isalnum() else ends.sub("", low) or low)

        self.hashes = Coded(code, _WORDS_KEPT)

    def __call__(self, text: str):
        """Distinct shingle hashes in order, and their counts."""
        import numpy as np

        words = self.words(text)
        if not words:
            return np.empty(0, "u8"), np.empty(0, "f8")
        h = self.hashes.of(words, len(words))
        n = max(1, len(h) - SHINGLE_WORDS + 1)
        out = np.zeros(n, "u8")
        for i in range(min(SHINGLE_WORDS, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        got, counts = np.unique(mix(out), return_counts=True)
        return got, counts.astype("f8")


def mix(x):
    """The finaliser of splitmix64, on arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[tuple], registers: int):
    """ProbMinHash signatures of weighted sets (hashes, weights), all at once; a row of hashes for each set."""
    import numpy as np

    n = len(sets)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    items = np.concatenate([h for h, _ in sets]) if n else np.empty(0, "u8")
    rate = np.concatenate([w for _, w in sets]) if n else np.empty(0)
    best = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, "u8")
    time, arrival = np.zeros(len(items)), 0
    while len(items):
        # few processes left: look at several arrivals of each at once
        ahead = int(min(64, max(1, 65_536 // len(items))))
        seeds = items[:, None] + np.arange(arrival + 1, arrival + 1 + ahead, dtype="u8") * np.uint64(0xD1342543DE82EF95)
        a = mix(seeds)
        gaps = -np.log(((a >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / rate[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        where = owner[:, None] * registers + (mix(a + np.uint64(0x632BE59BD9B4E019)) % np.uint64(registers)).astype("i8")
        at, t = where.ravel(), times.ravel()
        early = t < best[at]
        at, t, by = at[early], t[early], np.repeat(items, ahead)[early]
        np.minimum.at(best, at, t)
        won = t == best[at]
        sig[at[won]] = by[won]
        time, arrival = times[:, -1], arrival + ahead
        go = time < best.reshape(n, registers).max(axis=1)[owner]
        items, owner, rate, time = items[go], owner[go], rate[go], time[go]
    return sig.reshape(n, registers)


def similarity(a, wa, b, wb) -> float:
    """Probability Jaccard similarity of two weighted sets given by sorted hashes and weights."""
    import numpy as np

    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    if (x == y).all():
        # max(x_j / x_i, y_j / y_i) is x_j / x_i throughout
        return float(x.sum() / (x.sum() + only_a + only_b))
    order = np.argsort(x / y, kind="stable")
    x, y, r = x[order], y[order], (x / y)[order]
    # for i: x_j / x_i is the larger where x_j / y_j >= x_i / y_i
    tail_x = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    head_y = np.concatenate([[0.0], np.cumsum(y)])
    first = np.searchsorted(r, r, "left")
    return float((1.0 / ((tail_x[first] + only_a) / x + (head_y[first] + only_b) / y)).sum())


def jaccard(a, b) -> float:
    """Jaccard similarity of two sets given by distinct hashes."""
    import numpy as np

    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n) if n else 0.0


def _text_node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node, buckets (one for each band; none without a word) and the registers' low 16 bits. docs: doc_id, text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle = Shingler()

        def emit(ids, nodes, sets):
            sig = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype="u8"), (len(sets), bands)).copy()
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            some = np.array([len(h) > 0 for h, _ in sets], bool)
            short = (sig & np.uint64(0xFFFF)).astype("<u2").reshape(len(sets), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(key[some].astype("u8").view("i8").ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), lists.cast(pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "node", "buckets", "sig"])

        for batch in batches:
            ids, nodes, sets, n = [], [], [], 0
            for i, node, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                s = shingle(text.as_py())
                ids.append(i.as_py())
                nodes.append(node.as_py())
                sets.append(s)
                n += len(s[0])
                if n > 100_000:
                    yield emit(ids, nodes, sets)
                    ids, nodes, sets, n = [], [], [], 0
            if ids:
                yield emit(ids, nodes, sets)

    return map_arrow(docs.select("doc_id", _text_node(F.col("text")).alias("node"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, "doc_id bigint, node binary, buckets array<bigint>, sig binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """lead, node and their distances d_p = 1 - J_P and d_j = 1 - J. Pairs are dealt out by range, so one leader's are
    many tasks' work; its set goes once to each of them."""
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS_A_TASK))
    salted = staged(pairs.repartitionByRange(tasks, "lead", "node").withColumn("salt", F.spark_partition_id()), "minhash-pairs")
    members = salted.select("node", "lead", "salt", F.lit(1).alias("kind"))
    leaders = salted.select(F.col("lead").alias("node"), "lead", "salt", F.lit(0).alias("kind")).distinct()
    both = members.unionByName(leaders).join(sets, "node").select("lead", "salt", "kind", "node", "hashes", "weights")
    both = both.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        own = None
        for batch in batches:
            lead, kind, node = (batch.column(i).to_pylist() for i in (0, 2, 3))
            hashes, weights = batch.column(4), batch.column(5)
            out: list[tuple] = []
            for i in range(batch.num_rows):
                h, w = hashes[i].values.to_numpy(zero_copy_only=False).view("u8"), weights[i].values.to_numpy(zero_copy_only=False).astype("f8")
                if kind[i] == 0:
                    own = h.copy(), w
                else:
                    out.append((lead[i], node[i], 1.0 - similarity(*own, h, w), 1.0 - jaccard(own[0], h)))
            types = (pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], ["lead", "node", "d_p", "d_j"])

    return map_arrow(both, run, "lead binary, node binary, d_p double, d_j double")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node of its connected component, for the ends of edges (a, b)."""
    now = staged(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low != high").distinct(), "components")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("low", "high"))).first())
    seen = print_of(now)
    while True:
        # large star: higher neighbours move to the least neighbour
        ends = now.select(F.col("low").alias("u"), F.col("high").alias("v")).union(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low != high").distinct()
        # small star: lower neighbours and the node itself move to the least of them
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(least, "high")
        small = moved.select(F.col("m").alias("low"), F.col("low").alias("high")).union(moved.select(F.col("m").alias("low"), "high")).where("low != high").distinct()
        now = staged(small, "components")
        got = print_of(now)
        if got == seen:
            break
        seen = got
    return now.select(F.col("high").alias("node"), F.col("low").alias("comp")).union(now.select(F.col("low").alias("node"), F.col("low").alias("comp")).distinct())


def _least_agreement(threshold: float, registers: int) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / registers) ** 0.5


def _links_within(groups: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of members of one leader. groups: lead, n, node, d_p, d_j, comp, sig, hashes, weights.

    n: shingles of all members of the leader.
    """
    limit = 1.0 - threshold
    rows = groups.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a task for every pair of blocks; a group of one block is one task
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "d_p", "d_j", "comp", "sig", "hashes", "weights")
    rows = rows.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "block")

    def compare(block: list[tuple], same: bool) -> Iterator[tuple]:
        import numpy as np

        number = {c: k for k, c in enumerate({r[4] for r in block})}
        top = list(range(len(number)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        cut = len(block) if same else next((k for k, r in enumerate(block) if r[0] != block[0][0]), len(block))
        comp = np.array([number[r[4]] for r in block])
        d_p, d_j = (np.array([r[c] for r in block]) for c in (2, 3))
        short = np.frombuffer(b"".join(r[5] for r in block), "<u2").reshape(len(block), -1)
        sets = lambda k: (block[k][6].view("u8"), block[k][7].astype("f8"))
        long: dict[int, tuple] = {}
        few, many = _least_agreement(threshold, short.shape[1]), _least_agreement(threshold, LONG)

        def signed(members: list[int]) -> list:
            """Long signatures, weighted and plain, made when a short one has passed."""
            new = [k for k in members if k not in long]
            for start in range(0, len(new), 256):
                part = new[start : start + 256]
                own = [sets(k) for k in part]
                both = signatures(own, LONG).astype("u4"), signatures([(h, np.ones(len(h))) for h, _ in own], LONG).astype("u4")
                long.update(zip(part, zip(*both)))
            return [np.array([long[k][way] for k in members]) for way in range(2)]

        begin = 0 if same else cut
        for k in range(cut):
            start = max(begin, k + 1) if same else begin
            near = (np.abs(d_p[start:] - d_p[k]) <= limit + EPS) | (np.abs(d_j[start:] - d_j[k]) <= limit + EPS)
            at = start + np.flatnonzero(near & (comp[start:] != comp[k]))
            at = at[(short[at] == short[k]).mean(axis=1) >= few] if len(at) else at
            at = at[np.any([(x[1:] == x[0]).mean(axis=1) >= many for x in signed([k, *at.tolist()])], axis=0)] if len(at) else at
            for m in at.tolist():
                a, b = find(comp[k]), find(comp[m])
                if a != b and max(similarity(*sets(k), *sets(m)), jaccard(sets(k)[0], sets(m)[0])) >= threshold - EPS:
                    top[max(a, b)] = min(a, b)
                    yield block[k][1], block[m][1]

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        key, block = None, []

        def flush():
            out = list(compare(block, key[1] == key[2])) if len({r[4] for r in block}) > 1 and (key[1] == key[2] or block[0][0] != block[-1][0]) else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(9)]
            for n, (lead, i, j, *row) in enumerate(zip(*columns)):
                if (lead, i, j) != key:
                    if key:
                        yield flush()
                    key, block = (lead, i, j), []
                own = (batch.column(c)[n].values.to_numpy(zero_copy_only=False).copy() for c in (9, 10))
                block.append((*row, *own))
        if key:
            yield flush()

    return map_arrow(rows, run, "a binary, b binary")


def _filter_bits(node: Column) -> Column:
    return F.array(F.pmod(F.xxhash64(node), F.lit(FILTER_BITS)), F.pmod(F.xxhash64(F.lit(SECOND_SEED), node), F.lit(FILTER_BITS)))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes, weights of the wanted nodes. docs: node, text; wanted: node.

    A Bloom filter of fixed size keeps most other texts from being shingled, and each task shingles equal texts once;
    an exact semi-join follows. A full filter lets all pass and costs time, not results.
    """
    import numpy as np

    table = bit_table(wanted.select(F.explode(_filter_bits(F.col("node"))).alias("bit")), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        seen, shingle, bits = set(), Shingler(), shared.value.view("u8")
        for batch in batches:
            pos = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            hit = ((bits[pos >> 6] >> (pos & 63).astype("u8")) & np.uint64(1)).all(axis=1)
            rows = np.flatnonzero(hit)
            for start in range(0, len(rows), 256):
                nodes, sets = [], []
                for k in rows[start : start + 256].tolist():
                    node = batch.column(0)[k].as_py()
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(shingle(batch.column(1)[k].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([h.view("i8") for h, _ in sets], pa.list_(pa.int64())), pa.array([w.astype("i4") for _, w in sets], pa.list_(pa.int32()))], ["node", "hashes", "weights"])

    found = map_arrow(docs.select("node", F.coalesce("text", F.lit("")).alias("text"), _filter_bits(F.col("node")).alias("pos")), run, "node binary, hashes array<bigint>, weights array<int>")
    return found.dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi")


def _linked(found: DataFrame, limit: float) -> DataFrame:
    return found.where(F.least("d_p", "d_j") <= limit + EPS).select(F.col("lead").alias("a"), F.col("node").alias("b"))


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (MD5 of the text), class_key, class_id and class_size of every row, and links: the node's
    verified pairs at the threshold that were looked at, with leaders and between components, not all its neighbours."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    limit = 1.0 - threshold
    signed = staged(_signed(docs, bands, rows), "minhash-signed")
    nodes = staged(signed.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least_id"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig")), "minhash-nodes")
    bucketed = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = staged(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-sizes")
    members = staged(spread_join(bucketed, sizes, "bucket", "n").where("n is not null"), "minhash-members")
    ranked = staged(members.groupBy("node").agg(F.sum("n").alias("met")), "minhash-centrality")
    best = F.max(F.struct("met", "node"))["node"].alias("lead")
    leads = staged(members.join(ranked, "node").groupBy("bucket").agg(best, F.max("n").alias("n")), "minhash-leads")
    pairs = spread_join(members.select("bucket", "node"), leads, "bucket", "n").where("node != lead").select("lead", "node").distinct()
    pairs = staged(pairs, "minhash-led")
    sets = staged(_sets_of(docs.select(_text_node(F.col("text")).alias("node"), "text"), ranked), "minhash-sets")

    found = staged(_verified(pairs, sets), "minhash-distances")
    links = _linked(found, limit)
    comp = components(links)
    # members of one leader in several components: the only places where a link can be missing
    at_lead = found.union(found.select("lead", F.col("lead").alias("node"), F.lit(0.0).alias("d_p"), F.lit(0.0).alias("d_j")).distinct())
    at_lead = at_lead.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    at_lead = staged(at_lead.join(sets.select("node", F.size("hashes").alias("size")), "node"), "minhash-at-lead")
    split = at_lead.groupBy("lead").agg(F.sum("size").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2")
    split = staged(split.select("lead", "n"), "minhash-split")
    few = split.limit(MAX_BROADCAST_LEADERS + 1).count() <= MAX_BROADCAST_LEADERS
    open_ = staged(at_lead.join(F.broadcast(split) if few else split, "lead").drop("size"), "minhash-open")
    full = open_.join(nodes.select("node", "sig"), "node").join(sets, "node")
    links2 = staged(_links_within(full, threshold), "minhash-links")
    # links between components join those
    of = lambda end: comp.select(F.col("node").alias(end), F.col("comp").alias(f"c_{end}"))
    joined = links2.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    comp2 = components(joined).withColumnsRenamed({"node": "c_node", "comp": "c_comp"})

    degree = links.unionByName(links2).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    own = nodes.drop("buckets", "sig").join(comp, "node", "left").join(degree, "node", "left")
    own = staged(own.select("node", "rows", "least_id", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")), "minhash-own")
    # classes are summed up from components, and go back to components, nodes and rows in turn
    comps = own.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.min("least_id").alias("least_id"))
    comps = staged(comps.join(comp2, F.col("comp") == F.col("c_node"), "left").select("comp", "n", "rows", "least_id", F.coalesce("c_comp", "comp").alias("key")), "minhash-comps")
    ids = comps.groupBy("key").agg(F.min("least_id").alias("class_id"), F.sum("rows").alias("class_size"))
    comps = staged(comps.select("comp", "n", "key").join(ids, "key"), "minhash-classes")
    own = staged(spread_join(own.select("node", "rows", "links", "comp"), comps, "comp", "n").drop("comp", "n"), "minhash-classed")
    out = spread_join(signed.select("doc_id", "node"), own, "node", "rows")
    return out.select("doc_id", "node", "class_id", F.lower(F.hex("key")).alias("class_key"), "class_size", "links")


def keep_one(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class, that with the least (doc_id, text hash), with the columns of docs."""
    first = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("x"))
    keep = first.select(F.col("x.no_id").alias("__no_id"), F.coalesce("x.doc_id", F.lit(0)).alias("__id"), F.col("x.node").alias("__node"))
    keys = ["__no_id", "__id", "__node"]
    own = docs.withColumns({"__no_id": F.col(doc_id).isNull(), "__id": F.coalesce(F.col(doc_id), F.lit(0)), "__node": _text_node(F.col(text))})
    return own.join(keep, keys, "left_semi").dropDuplicates(keys).drop(*keys)
