import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlearn.operators import pca, sampling, sketch

RNG = np.random.default_rng(2)


def vectors(spark, data, keys=1):
    return spark.createDataFrame([(i % keys, i, x.tolist()) for i, x in enumerate(data)], "pid int, seq bigint, data array<double>")


def test_simple_reservoir_is_uniform(spark):
    df = spark.range(400).crossJoin(spark.range(300).withColumnRenamed("id", "pid")).select("pid", F.col("id").alias("seq"))
    out = sampling.SimpleReservoirSampling(k=20, output="reservoir").transform(df)
    assert out.count() == 300 * 20
    low = out.where("seq < 200").count() / 6000
    assert abs(low - 0.5) < 0.04
    again = sampling.SimpleReservoirSampling(k=20, output="reservoir").transform(df.repartition(7))
    assert out.exceptAll(again).count() == 0


def test_weighted_reservoir(spark):
    df = spark.createDataFrame([(0, i, [0.1 * i]) for i in range(9)], "pid int, seq bigint, data array<double>")
    out = sampling.WeightedReservoirSampling(k=4).transform(df)
    assert out.count() == 4 and out.where("seq = 0").count() == 0  # weight 0 is never drawn
    many = spark.range(4000).select(F.col("id").alias("pid"), F.explode(F.array(F.lit(1.0), F.lit(9.0))).alias("w")).withColumn("seq", F.col("w").cast("bigint"))
    heavy = sampling.WeightedReservoirSampling(k=1, weight="w").transform(many).where("w = 9").count()
    assert abs(heavy / 4000 - 0.9) < 0.03


def exact_confidence(i, k, d, m):
    if k + d > i + m:
        return 0
    return sum(math.comb(i, x) * math.comb(m, k + d - x) for x in range(max(0, k + d - m), min(k, i) + 1)) / math.comb(i + m, k + d)


def test_uniformity_confidence():
    for i, k, d, m in itertools.product((8, 30), (4, 8), (1, 5), (1, 3, 20)):
        assert abs(sampling.uniformity_confidence(i, k, d, m) - exact_confidence(i, k, d, m)) < 1e-9
    m = sampling.least_extra(30, 4, 5, 0.9)
    assert exact_confidence(30, 4, 5, m) >= 0.9 > exact_confidence(30, 4, 5, m - 1)


@pytest.mark.parametrize(("k", "change"), [(4, 9), (9, 4), (4, 4)])
def test_adaptive_reservoir(spark, k, change):
    df = spark.range(6000).select((F.col("id") % 3).cast("int").alias("pid"), F.col("id").alias("seq"))
    out = sampling.AdaptiveReservoirSampling(k=k, change=change, threshold=0.8).transform(df).collect()
    assert len(out) == 3
    for r in out:
        assert r.size == change and len(set(r.members)) == change and all(m % 3 == r.pid for m in r.members)
    log = sampling.AdaptiveReservoirSampling(k=k, change=change, threshold=0.8, output="log").transform(df)
    assert log.count() == 6000 and log.where("size(members) > size").count() == 0


@pytest.mark.parametrize("keys", [1, 4])
def test_directions_keep_their_bound(spark, keys):
    a = RNG.normal(size=(200, 12)) * np.geomspace(5, 0.1, 12)
    ell = 8
    for how in (sketch.FrequentDirections(ell=ell), sketch.FrequentDirections(ell=ell, aggregate=True)):
        out = how.transform(vectors(spark, a, keys)).collect()
        b = np.array([r.data for r in out])
        gap = np.linalg.eigvalsh(a.T @ a - b.T @ b)
        assert gap.min() > -1e-6 and gap.max() <= 2 * (a**2).sum() / ell * (3 if how.params["aggregate"] else 1)
        assert len(b) <= ell * (1 if how.params["aggregate"] else keys)


def test_a_sketch_that_is_never_full_is_exact(spark):
    a = RNG.normal(size=(5, 3))
    b = np.array([r.data for r in sketch.FrequentDirections(ell=6).transform(vectors(spark, a)).orderBy("row").collect()])
    assert np.allclose(a, b)


def test_anomaly_sketch(spark):
    a = RNG.normal(size=(150, 10))
    b = np.array([r.data for r in sketch.AnomalySketch(ell=6).transform(vectors(spark, a)).collect()])
    gap = np.linalg.eigvalsh(a.T @ a - b.T @ b)
    assert b.shape == (6, 10) and gap.min() > -1e-6


def test_components_find_the_axes(spark):
    q = np.linalg.qr(RNG.normal(size=(6, 6)))[0]
    a = (RNG.normal(size=(4000, 6)) * [9, 4, 2, 0.3, 0.2, 0.1]) @ q.T
    out = pca.CCIPCA(components=3).transform(vectors(spark, a)).orderBy("component").collect()
    for i, r in enumerate(out):
        assert abs(np.dot(r.vector, q[:, i])) > 0.97
    assert np.allclose([r.value for r in out], [81, 16, 4], rtol=0.25)


def test_blocks_do_not_matter():
    a = RNG.normal(size=(100, 5))
    whole = pca.ccipca(a, 3, 2.5)
    parts = None
    for k in range(0, 100, 7):
        parts = pca.ccipca(a[k : k + 7], 3, 2.5, parts)
    assert parts[0] == whole[0] and np.allclose(parts[1], whole[1])


def test_statistics_and_limits(spark):
    p = np.linalg.qr(RNG.normal(size=(5, 2)))[0]
    x = RNG.normal(size=(20, 5))
    df = vectors(spark, x)
    rows = df.select("seq", pca.spe(F.col("data"), p.T.tolist()).alias("q"), pca.hotelling(F.col("data"), p.T.tolist(), [3.0, 2.0]).alias("t")).collect()
    for r in rows:
        v = x[r.seq]
        assert abs(r.q - np.linalg.norm(v - p @ (p.T @ v)) ** 2) < 1e-9
        assert abs(r.t - v @ p @ np.diag([1 / 3, 1 / 2]) @ p.T @ v) < 1e-9
    assert abs(pca.t_limit([1.0]) - 5.411894) < 1e-5 and abs(pca.t_limit([1.0] * 10) - 21.160768) < 1e-5
    assert math.isnan(pca.q_limit([5.0, 0.01, 0.01])) or pca.q_limit([5.0, 0.01, 0.01]) > 0
    assert pca.q_limit([1.0, 0.8, 0.5], form="classic") > sum([1.0, 0.8, 0.5])


def test_outliers_are_flagged(spark):
    a = RNG.normal(size=(800, 12)) * np.geomspace(3, 0.3, 12)
    a[5] += 40
    df = vectors(spark, a)
    out = {r.seq: r.anomaly for r in pca.PCAAnomaly(components=11, kept=3).fit(df).predict(df).collect()}
    assert out[5] and sum(out.values()) < 400
    with pytest.raises(RuntimeError):
        pca.PCAAnomaly().predict(df)
