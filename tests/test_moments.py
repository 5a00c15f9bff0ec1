import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlearn.operators import moments as M
from streamlearn.plans.running import numbered, running
from streamlearn.sources import tables as T

RNG = np.random.default_rng(1)
DATA = RNG.normal([2000, 3, 1], [800, 0.8, 5], (47, 3))


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i % 2, i, [0, 1, 2], x.tolist(), [1.0 + i % 4] * 3) for i, x in enumerate(DATA)]
    return spark.createDataFrame(rows, "pid int, seq bigint, slice array<int>, data array<double>, weight array<double>")


def test_merged_equals_whole(samples):
    out = {r.feature: r for r in M.MomentsEstimator(output="merged").transform(samples).collect()}
    for f in range(3):
        assert abs(out[f].mean - DATA[:, f].mean()) < 1e-9 and abs(out[f].variance - DATA[:, f].var(ddof=1)) < 1e-6


def test_partial_events_are_the_same(samples):
    cut = lambda a, b: samples.select("pid", "seq", F.slice("slice", a + 1, b - a).alias("slice"), F.slice("data", a + 1, b - a).alias("data"))
    split = cut(0, 2).union(cut(2, 3))
    whole = sorted(map(tuple, M.MomentsEstimator(output="final").transform(samples).collect()))
    assert np.allclose(sorted(map(tuple, M.MomentsEstimator(output="final").transform(split).collect())), whole)


def test_running(samples):
    for r in M.MomentsEstimator().transform(samples).collect():
        x = DATA[r.seq % 2 : r.seq + 1 : 2, r.feature]
        assert r.n == len(x) and abs(r.mean - x.mean()) < 1e-8
        assert (r.variance is None) if len(x) == 1 else abs(r.variance - x.var(ddof=1)) < 1e-5


def test_single_sample_merges(spark):
    models = spark.createDataFrame([(0, 1, 5.0, 0.0), (0, 3, 1.0, 2.0), (1, 1, 4.0, 0.0)], "feature int, n bigint, mean double, m2 double")
    out = {r.feature: r for r in M.merge_moments(models).collect()}
    assert out[0].n == 4 and out[0].mean == 2.0 and abs(out[0].variance - (2 + 16 * 3 / 4) / 3) < 1e-12 and out[1].variance is None


def test_weighted_golden(spark):
    # the weighted mean and variance of one feature with weights 1, 2, 4, in order and merged
    x, w = [2104.0, 1600.0, 2400.0], [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(0, i, [0], [a], [b]) for i, (a, b) in enumerate(zip(x, w))], "pid int, seq bigint, slice array<int>, data array<double>, weight array<double>")
    last = M.WeightedMomentsEstimator().transform(df).orderBy(F.desc("seq")).first()
    assert abs(last.mean - 2129.1428571429) < 1e-9 and abs(last.variance - 122010.122449) < 1e-5
    final = M.WeightedMomentsEstimator(output="merged").transform(df).first()
    assert abs(final.mean - last.mean) < 1e-9 and abs(final.variance - last.variance) < 1e-6


def test_exponential_golden(spark):
    df = spark.createDataFrame([(0, i, [0], [float(i)]) for i in (1, 2, 3)], "pid int, seq bigint, slice array<int>, data array<double>")
    out = M.ExponentialMomentsEstimator().transform(df).orderBy("seq").collect()
    assert np.allclose([(r.mean, r.variance) for r in out], [(0.2, 0.64), (0.56, 2.2016), (1.048, 4.250624)])
    with pytest.raises(ValueError):
        M.exponential(1.5)


def test_recurrence_is_the_loop():
    x = RNG.normal(size=3000)
    for decay in (0.2, 0.8, 0.999, 0.0, 1.0):
        y, want = 3.0, []
        for v in x:
            y = decay * y + v
            want.append(y)
        assert np.allclose(M.recurrence(decay, x, 3.0), want)


def test_running_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("hot").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
        out = running(df, ["k"], ["o"], {"s": "v", "n": F.lit(1)}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, counts = {None: 0, "hot": 0}, {None: 0, "hot": 0}
    for r in sorted(out, key=lambda r: r.o):
        sums[r.k] += r.v
        counts[r.k] += 1
        assert (r.s, r.n) == (sums[r.k], counts[r.k])
    assert numbered(df.limit(0), ["k"], ["o"]).count() == 0


def test_moving_stream_equals_batch(spark, sf_dir, tmp_path):
    from streamlearn.sources.tables import drain, stream

    events = T.event_samples(spark, sf_dir)
    events.repartitionByRange(3, "seq").write.parquet(f"{tmp_path}/in")
    how = M.MovingMomentsEstimator(length="24 hours", slide="12 hours", late="60 days")
    live = stream(spark, f"{tmp_path}/in", events.schema)
    out = how.transform(live)
    q = out.writeStream.format("memory").queryName("moving").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted((str(r.start), r.pid, r.feature, r.n, round(r.mean, 9), round(r.variance, 9)) for r in rows)
    assert key(spark.table("moving").collect()) == key(how.transform(events).collect())
    q2 = M.ExponentialMomentsEstimator().transform(live.select("pid", "seq", "slice", "data"))
    drain(q2, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    key = lambda df: sorted((r.pid, r.seq, r.feature, r.n, round(r.mean, 9), round(r.variance, 9)) for r in df.collect())
    assert len(key(spark.read.parquet(f"{tmp_path}/out"))) == len(key(M.ExponentialMomentsEstimator().transform(events)))


def test_events_without_a_key_are_dealt_out(spark):
    df = spark.range(4000).select(F.col("id").alias("seq"), F.array(F.lit(0)).alias("slice"), F.array((F.col("id") % 10).cast("double")).alias("data"))
    out = M.MomentsEstimator(output="final", partitions=8).transform(df)
    assert out.count() == 8 and out.agg(F.sum("n")).first()[0] == 4000 and out.agg(F.min("n")).first()[0] > 300
    key = lambda d: sorted((r.pid, r.n, round(r.mean, 9), round(r.variance, 9)) for r in d.collect())
    assert key(out) == key(M.MomentsEstimator(output="final", partitions=8).transform(df.repartition(5)))
    with pytest.raises(ValueError, match="pid"):
        M.MomentsEstimator(output="final").transform(df)
