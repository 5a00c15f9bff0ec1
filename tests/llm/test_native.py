import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamlearn.llm import linededup, quality, sharding
from streamlearn.llm import queries as Q
from streamlearn.plans.shared import staged as real

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_docs):
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            found[line_key(x)].add((i, t or ""))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not line_key(x) or len(found[line_key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    inside = {p + d for p, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("broadcast", [500_000, 0])
@pytest.mark.parametrize("min_docs", [2, 4])
def test_line_dedup_odd(odd_docs, min_docs, broadcast, monkeypatch):
    monkeypatch.setattr(linededup, "MAX_BROADCAST_LINES", broadcast)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = linededup.line_dedup(odd_docs, min_docs=min_docs)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in out.withColumn("kept", linededup.kept_text(F.col("text"), F.col("keep_runs"))).collect())
    assert got == brute_lines(rows, min_docs)
    assert set(odd_docs.columns) < set(out.columns)


def test_line_dedup_beside_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, "x"), (2, "b", 8, "y")], "doc_id bigint, text string, n_lines int, dropped string")
    out = linededup.line_dedup(docs, min_docs=2, names=("lines_", "gone_", "runs_")).orderBy("doc_id").collect()
    assert [(r.n_lines, r.dropped, r.lines_, r.gone_, r.runs_) for r in out] == [(7, "x", 2, 1, [1, 1, 0]), (8, "y", 1, 1, [0, 1, 0])]


def test_line_dedup_keeps_first(spark):
    docs = spark.createDataFrame([(1, "a\nb\na"), (2, "b\nc"), (3, "A \nd")], "doc_id bigint, text string")
    out = {r.doc_id: r.kept for r in linededup.line_dedup(docs, min_docs=1, keep_first=True).withColumn("kept", linededup.kept_text(F.col("text"), F.col("keep_runs"))).collect()}
    assert out == {1: "a\nb", 2: "c", 3: "d"}


def test_line_dedup_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in Q.read(spark, sf_dir, "documents").collect()]
    out = Q.op9_line_dedup(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == brute_lines(rows, 10)
    texts = dict(rows)
    for r in out:  # the bitmap says which lines those are
        keep = [n % 2 == 0 for n, k in enumerate(map(int, r.keep_runs.split(","))) for _ in range(k)]
        lines = (texts[r.doc_id] or "").split("\n")
        assert len(keep) == len(lines) == r.n_lines and keep.count(False) == r.n_dropped
        assert sha("\n".join(x for x, k in zip(lines, keep) if k)) == r.kept_sha256


def test_common_lines_stay_spread(spark, monkeypatch):
    """One line of a third of all documents: no task of the join reads all of it."""
    monkeypatch.setattr(linededup, "MAX_BROADCAST_LINES", 0)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "common\n").otherwise(""), F.lit("line "), "id").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = {}
        monkeypatch.setattr(linededup, "staged", lambda df, name: staged.setdefault(name, real(df, name)))
        out = linededup.line_dedup(docs)
        assert out.where("n_dropped = 1").count() == 2000 and out.where("n_dropped = 0").count() == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    runs = staged["line-runs"].groupBy("run").count().collect()
    assert max(r["count"] for r in runs) < 8000 / 4


def test_empty(spark, empty_docs):
    assert linededup.line_dedup(empty_docs).count() == 0
    assert sharding.shard_documents(empty_docs).count() == 0
    assert quality.features(empty_docs).count() == 0


def test_features(odd_docs, spark, sf_dir):
    for docs in (odd_docs, Q.read(spark, sf_dir, "documents")):
        want = Counter((r.doc_id, *brute_counts(r.text)) for r in docs.collect())
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(docs).collect())
        assert got == want


def test_binomial(spark):
    for n, k, p in ((10, 3, 0.2), (500, 0, 0.01), (3000, 40, 0.0166), (3, 5, 0.3)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(min(k, n) + 1))
        got = spark.range(1).select(quality.binomial_cdf(F.lit(min(k, n)).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert abs(got - want) < 1e-9


def test_cutoffs_hold_their_risk(spark):
    clean = [(i, "en", f"word{i} " * 1 + " ".join(f"t{i}x{j}" for j in range(60))) for i in range(3000)]
    junk = [(5000 + i, "en", " ".join(f"t{i}x{j}%%%" for j in range(60))) for i in range(400)]
    few = [(9000 + i, "xx", " ".join(f"t{i}x{j}|" for j in range(60))) for i in range(30)]
    docs = spark.createDataFrame(clean + junk + few, "doc_id bigint, lang string, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    feats = quality.features(docs).cache()
    out = quality.judge(feats, quality.fit_cutoffs(feats, labels)).groupBy("stratum", F.expr("doc_id < 5000").alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k"))
    got = {(r.stratum, r.good): r.k for r in out.collect()}
    assert got[("en", True)] == 1 and got[("en", False)] == 0
    assert got[("xx", False)] == 1  # no clean documents to certify anything with


def test_quality_query(spark, small_dir, sf_dir):
    for d in (small_dir, sf_dir):
        docs = Q.read(spark, d, "documents").collect()
        out = Q.op4_quality_rules(spark, d).collect()
        assert Counter(tuple(r)[:6] for r in out) == Counter((r.doc_id, *brute_counts(r.text)) for r in docs)
        for r in out:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_shards(spark, sf_dir, odd_docs):
    for docs, n in ((Q.read(spark, sf_dir, "documents"), 40), (odd_docs, 3), (odd_docs, 40)):
        rows = docs.select("doc_id", "text").collect()
        out = sharding.shard_documents(docs, shards=n).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
        slots, of = defaultdict(list), defaultdict(set)
        for r in out:
            slots[r.shard].append(r.slot)
            of[(r.size, r.text_crc32)].add(r.shard)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(n))
        assert all(len(x) == 1 for x in of.values())


def brute_capacity(sizes, shards):
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], sum(sizes[i:j])) for i in range(j + 1)) for j in range(1, len(sizes) + 1)]
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=14), st.integers(1, 6))
def test_capacity_is_minimal(sizes, shards):
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    c = sharding.smallest_capacity(ends, max(sizes), shards)
    assert c == brute_capacity(sizes, shards)
    cuts = [0, *sharding.even_cuts(ends, c, shards), len(sizes)]
    assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) <= c


def test_blocks_find_the_cuts_of_groups(spark, monkeypatch):
    groups = spark.range(5000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", "id").alias("h2"), (F.col("id") % 97 + 20).alias("bytes")).cache()
    whole = sharding.find_cuts(groups, 12, [])
    monkeypatch.setattr(sharding, "MAX_ITEMS", 256)
    assert sharding.find_cuts(groups, 12, []) == whole


def test_sharding_query(spark, sf_dir):
    out = Q.op3_sharding(spark, sf_dir).collect()
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in Q.read(spark, sf_dir, "documents").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
