"""The pipeline against brute force, stage by stage, and whole."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import pytest
from test_minhash import brute_classes
from test_native import brute_counts, line_key
from tokenizers import Tokenizer

import corpus_pipeline as P
from streamlearn.llm import queries as Q
from streamlearn.llm import quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = Q.read(spark, sf_dir, "documents"), []
    for _, stage in P.STAGES:
        docs = P.staged(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_whole(spark, sf_dir, stages):
    first = Q.read(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in first.collect()}
    # quality rules: with this few labels nothing can be certified beyond the base rules
    feats = quality.features(first)
    assert quality.fit_cutoffs(feats, Q.read(spark, sf_dir, "labels")).count() == 0
    rows = {i: t for i, t in rows.items() if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert {r.doc_id for r in stages[0].collect()} == set(rows) and stages[0].columns == first.columns
    # line dedup
    found = defaultdict(set)
    for i, t in rows.items():
        for x in t.split("\n"):
            found[line_key(x)].add(i)
    rows = {i: "\n".join(x for x in t.split("\n") if not line_key(x) or len(found[line_key(x)]) < 10) for i, t in rows.items()}
    assert {r.doc_id: r.text for r in stages[1].collect()} == rows
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())
    # near-dedup
    listed = sorted(rows.items())
    keep = {min(listed[n][0] for n in g) for g in brute_classes(listed)}
    rows = {i: rows[i] for i in keep}
    assert {r.doc_id: r.text for r in stages[2].collect()} == rows
    # decontamination: whole items, any case
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r.text) for r in Q.read(spark, sf_dir, "benchmark").collect()]
    left = {r.doc_id for r in stages[3].collect()}
    assert left < set(rows) and not any(p in plain(rows[i]) for i in left for p in items)
    gone = set(rows) - left
    assert all(any(" ".join(w) in plain(rows[i]) for p in items for w in zip(*[p.split()[j:] for j in range(5)])) for i in gone)
    # BPE
    t = Tokenizer.from_file(Q.vocabulary())
    want = Counter()
    for i in left:
        ids = t.encode(rows[i], add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in stages[4].collect()) == want
    assert Counter((r.doc_id, r.ids_sha256) for r in P.run(spark, sf_dir).collect()) == Counter((k[0], k[2]) for k in want)


def test_odd(spark, small_dir):
    """Nulls, repeated rows, empty texts: each of the odd rows fails a base rule, and the run still has its columns."""
    out = P.run(spark, small_dir)
    assert out.collect() == [] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_certified_cutoffs_act(spark, labelled_dir):
    """Junk beyond the base rules goes, where clean labelled documents certify a cutoff, and the copy of an item."""
    docs = Q.read(spark, labelled_dir, "documents")
    assert {r.doc_id for r in P.quality_rules(spark, docs, labelled_dir).collect()} == {*range(3000), *range(9000, 9030)}
    assert {r.doc_id for r in P.run(spark, labelled_dir).collect()} == {*range(3000), *range(9000, 9030)} - {7}


def test_clashing_columns_and_empty_tables(spark, small_dir, sf_dir):
    docs = Q.read(spark, sf_dir, "documents").limit(60)
    more = docs.selectExpr("*", "1 as node", "'x' as text_hash", "2 as n", "3 as dropped", "4 as keep_runs", "5 as kept", "6 as comp", "7 as d", "8 as stratum")
    for _, stage in P.STAGES[:-1]:
        key = lambda d: sorted((r.doc_id, r.text or "") for r in d.collect())
        out, plain = stage(spark, more, sf_dir), stage(spark, docs, sf_dir)
        assert out.columns == more.columns and key(out) == key(plain)
    assert P.STAGES[-1][1](spark, more, sf_dir).count() == 60
    empty = docs.where("doc_id < 0")
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
