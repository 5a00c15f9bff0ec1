from collections import Counter, defaultdict

import numpy as np
import pytest

from streamlearn.llm import minhash as M
from streamlearn.llm import queries as Q


def jp(a, b):
    """Probability Jaccard straight from its definition."""
    union = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in union) for i in a.keys() & b.keys())


def brute_classes(rows, threshold=0.8):
    """Groups of row numbers, comparing all pairs that share a shingle."""
    shingle = M.Shingler()
    sets = [shingle(t or "") for _, t in rows]
    of, pairs = defaultdict(list), set()
    for n, (h, _) in enumerate(sets):
        for x in h.tolist():
            pairs.update((m, n) for m in of[x])
            of[x].append(n)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    texts = {}
    for n, (_, t) in enumerate(rows):
        top[find(n)] = find(texts.setdefault(t or "", n))
    for a, b in pairs:
        if find(a) != find(b) and max(M.similarity(*sets[a], *sets[b]), M.jaccard(sets[a][0], sets[b][0])) >= threshold - 1e-9:
            top[find(a)] = find(b)
    groups = defaultdict(list)
    for n in range(len(rows)):
        groups[find(n)].append(n)
    return groups.values()


def same(spark_rows, rows):
    got = defaultdict(list)
    for r in spark_rows:
        got[r.class_key].append(r.doc_id)
    want = [[rows[n][0] for n in g] for g in brute_classes(rows)]
    key = lambda ids: tuple(sorted((i is None, i or 0) for i in ids))
    assert Counter(map(key, got.values())) == Counter(map(key, want))
    for r in spark_rows:
        known = [i for i in got[r.class_key] if i is not None]
        assert r.class_id == (min(known) if known else None) and r.class_size == len(got[r.class_key])


def test_similarity_is_its_definition():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        a = {int(k): float(w) for k, w in zip(rnd.choice(40, 20, False), rnd.integers(1, 5, 20))}
        b = {int(k): float(w) for k, w in zip(rnd.choice(40, 15, False), rnd.integers(1, 5, 15))}
        split = lambda d: (np.array(sorted(d), "u8"), np.array([d[k] for k in sorted(d)]))
        assert abs(M.similarity(*split(a), *split(b)) - jp(a, b)) < 1e-12


def test_signatures_estimate_it():
    rnd = np.random.default_rng(5)
    keys = M.mix(np.arange(1, 300, dtype="u8"))
    a = np.sort(keys[:200]), rnd.integers(1, 4, 200).astype("f8")
    b = np.sort(keys[60:260]), rnd.integers(1, 4, 200).astype("f8")
    s = M.signatures([a, b, (keys[:1], np.ones(1)), (keys[:0], np.ones(0))], 4096)
    assert abs((s[0] == s[1]).mean() - M.similarity(*a, *b)) < 0.04
    assert (s[2] == keys[0]).all() and (s[3] == 0).all()


def test_signatures_do_not_depend_on_the_batch():
    sets = [(np.sort(M.mix(np.arange(i, i + n, dtype="u8"))), np.ones(n)) for i, n in ((1, 3), (50, 400), (600, 70_000))]
    whole = M.signatures(sets, 128)
    assert all((M.signatures([s], 128)[0] == whole[i]).all() for i, s in enumerate(sets))


def test_odd(odd_docs, empty_docs):
    same(M.classes(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert M.classes(empty_docs).count() == 0
    kept = M.keep_one(odd_docs, M.classes(odd_docs))
    assert kept.columns == odd_docs.columns and kept.count() == M.classes(odd_docs).select("class_key").distinct().count()


def test_chains_and_mixed_buckets(spark):
    """Chains of near copies, and buckets whose leader is unlike the others, lose no link."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(60):
        words = list(base)
        for j in range(n % 12):
            words[(j * 9 + n // 12) % 120] = f"x{n}_{j}"
        rows.append((n, " ".join(words)))
    rows += [(100 + n, " ".join([f"y{n}"] * 3 + base[:40])) for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(M.classes(docs).collect(), rows)
    same(M.classes(docs, bands=64, rows=1).collect(), rows)


def test_shingles_keep_equal_words_equal():
    s = M.Shingler()
    same_as = lambda a, b: list(s(a)[0]) == list(s(b)[0])
    assert same_as("One, two THREE four five.", "one two\tthree (four) five") and not same_as("a b c d e", "a b c d f")
    assert len(s("a b")[0]) == 1 and len(s("")[0]) == 0 and len(s("... !!! a b c")[0]) == 1


def test_repeats_link_by_either_similarity(spark):
    line = " ".join(f"r{i}" for i in range(8)) + " "
    rest = " ".join(f"w{i}" for i in range(60))
    rows = [(0, line * 9 + rest), (1, line * 2 + rest), (2, " ".join(f"z{i}" for i in range(60)))]
    sets = [M.Shingler()(t) for _, t in rows]
    assert M.similarity(*sets[0], *sets[1]) < 0.8 <= M.jaccard(sets[0][0], sets[1][0])
    same(M.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_components(spark):
    edges = [(bytes([a]), bytes([a + 1])) for a in range(1, 60) if a % 20] + [(b"\xf0", bytes([b])) for b in range(100, 140)]
    got = {bytes(r.node): bytes(r.comp) for r in M.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(got[bytes([a])] == bytes([(a - 1) // 20 * 20 + 1]) for a in range(1, 60))
    assert all(got[bytes([b])] == b"\x64" for b in [*range(100, 140), 0xF0])


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_query(spark, sf_dir, small_dir, where):
    d = sf_dir if where == "sf" else small_dir
    same(Q.op1_minhash_dedup(spark, d).collect(), [(r.doc_id, r.text) for r in Q.read(spark, d, "documents").collect()])
