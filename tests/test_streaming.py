"""Streams give what batches give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlearn.operators import evaluation, lasso, moments, online, pca, sampling, sax, sketch, topics
from streamlearn.sources import tables as T
from streamlearn.streaming.models import TopicStream

RNG = np.random.default_rng(6)


@pytest.fixture
def live(spark, tmp_path):
    """Writes a table as files in order of seq and reads it as a stream of one file a micro-batch."""

    def of(df, parts=3):
        top = df.agg(F.max("seq")).first()[0] + 1
        for k in range(parts):
            # file names decide the order in which a stream takes files
            df.where((F.col("seq") * parts >= k * top) & (F.col("seq") * parts < (k + 1) * top)).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    return of


def drained(spark, df, tmp_path):
    T.drain(df, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out")


def test_reservoir_log(spark, sf_dir, live, tmp_path):
    df = T.event_samples(spark, sf_dir).select("pid", "seq")
    how = sampling.SimpleReservoirSampling(k=5)
    key = lambda d: sorted((r.pid, r.seq, r.slot) for r in d.collect())
    assert key(drained(spark, how.transform(live(df)), tmp_path)) == key(how.transform(df))


def test_adaptive_reservoir(spark, sf_dir, live, tmp_path):
    df = T.event_samples(spark, sf_dir).select("pid", "seq")
    how = sampling.AdaptiveReservoirSampling(k=4, change=7, threshold=0.8)
    last = drained(spark, how.transform(live(df)), tmp_path).groupBy("pid").agg(F.max_by("members", "seq").alias("members"))
    key = lambda d: sorted((r.pid, r.members) for r in d.collect())
    assert key(last) == key(how.transform(df))


def test_exponential_moments(spark, sf_dir, live, tmp_path):
    df = T.event_samples(spark, sf_dir).drop("ts")
    how = moments.ExponentialMomentsEstimator()
    key = lambda d: sorted((r.pid, r.seq, r.feature, r.n, round(r.mean, 9), round(r.variance, 9)) for r in d.collect())
    assert key(drained(spark, how.transform(live(df)), tmp_path)) == key(how.transform(df))


@pytest.mark.parametrize("how", [sketch.FrequentDirections(ell=4), pca.CCIPCA(components=3)])
def test_matrices(spark, live, tmp_path, how):
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(RNG.normal(size=(60, 5)))], "pid int, seq bigint, data array<double>")
    out = drained(spark, how.transform(live(df)), tmp_path)
    flat = lambda d: sorted(str([round(abs(v), 6) for v in (r.asDict().get("data") or r.asDict()["vector"])]) for r in d.collect())
    # rows of the last micro-batch are the batch's
    assert set(flat(how.transform(df))) <= set(flat(out))


def test_labels_are_joined(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    p = spark.createDataFrame(rows, "idx bigint, t string").select("idx", F.col("t").cast("timestamp").alias("at"), (F.col("idx") * 1.0).alias("prediction"))
    y = p.select("idx", (F.col("at") + F.expr("INTERVAL 2 MINUTES")).alias("told"), F.lit(1.0).alias("label")).where("idx % 3 = 0")
    p.write.parquet(f"{tmp_path}/p")
    y.write.parquet(f"{tmp_path}/y")
    read = lambda n, s: spark.readStream.schema(s).parquet(f"{tmp_path}/{n}")
    out = evaluation.match(read("p", p.schema), read("y", y.schema), ["idx"], late=("at", "told", "10 minutes"))
    got = drained(spark, out, tmp_path)
    assert sorted(r.idx for r in got.collect()) == list(range(0, 30, 3))
    assert evaluation.match(p.drop("at"), y.drop("told"), ["idx"]).count() == 10


def test_topics(spark, live, tmp_path):
    kinds = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]]
    df = spark.createDataFrame([(i, i, RNG.choice(kinds[i % 2], 30).tolist()) for i in range(90)], "seq bigint, doc_id bigint, tokens array<string>")
    steps = []
    feed = TopicStream(topics.OnlineLDA(topics=2, words=30, offset=1.0), lambda m, n: steps.append(n))
    feed.write(live(df).select("doc_id", "tokens")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert len(steps) == 3 and feed.model.steps == 3
    assert np.argmax([r for r in feed.model.predict(df).orderBy("doc_id").first().topics]) in (0, 1)


@pytest.mark.parametrize("how", [moments.MomentsEstimator(), moments.WeightedMomentsEstimator()])
def test_running_moments(spark, sf_dir, live, tmp_path, how):
    df = T.event_samples(spark, sf_dir).drop("ts")
    rounded = lambda x: None if x is None else round(x, 7)
    key = lambda d: sorted((r.pid, r.seq, r.feature, r.n, rounded(r.mean), rounded(r.variance) or 0) for r in d.collect())
    assert key(drained(spark, how.transform(live(df)), tmp_path)) == key(how.transform(df))


@pytest.mark.parametrize("how", [moments.MomentsEstimator(output="merged"), moments.MomentsEstimator(output="final"), moments.WeightedMomentsEstimator(output="merged")])
def test_merged_moments(spark, sf_dir, live, tmp_path, how):
    df = T.event_samples(spark, sf_dir).drop("ts")
    query = how.transform(live(df)).writeStream.format("memory").queryName("merged").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    key = lambda d: sorted((r.asDict().get("pid"), r.feature, r.n, round(r.mean, 7), round(r.variance, 6)) for r in d.collect())
    assert key(spark.table("merged")) == key(how.transform(df))


def test_weighted_reservoir(spark, sf_dir, live, tmp_path):
    df = T.event_samples(spark, sf_dir).select("pid", "seq", "data")
    how = sampling.WeightedReservoirSampling(k=4)
    out = drained(spark, how.transform(live(df)), tmp_path)
    last = out.join(out.groupBy("pid").agg(F.max("at").alias("at")), ["pid", "at"])
    key = lambda d: sorted((r.pid, r.rank, r.seq, r.priority) for r in d.collect())
    assert key(last) == key(how.transform(df))


def test_running_confusion(spark, sf_dir, live, tmp_path):
    t = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("pid"), F.col("event_id").alias("seq"), (F.col("value") - 40).alias("prediction"), F.when(F.col("user_id") % 3 == 0, -1.0).when(F.col("user_id") % 3 == 1, 1.0).alias("label"))
    out = drained(spark, evaluation.running_confusion(live(t), ["pid"], ["seq"]), tmp_path)
    want = evaluation.running_confusion(t, ["pid"], ["seq"]).fillna(0, ["tp", "fp", "tn", "fn"])
    key = lambda d: sorted((r.pid, r.seq, r.tp, r.fp, r.tn, r.fn, r.accuracy, r.f) for r in d.collect())
    assert key(out) == key(want)


def test_dictionary(spark, sf_dir, live, tmp_path):
    t = T.table(spark, sf_dir, "events")
    words = t.select((F.col("user_id") % 4).cast("string").alias("class"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("word"))
    asked = t.select((F.col("user_id") % 8).cast("int").alias("key"), F.col("event_id").alias("seq"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("word"))
    model = sax.SAXDictionary(words=5, order="seq").fit(words)
    key = lambda d: sorted((r.key, r.window_no, r["class"], round(r.similarity, 9)) for r in d.collect())
    want = key(model.predict(asked))
    assert key(drained(spark, model.predict(live(asked)), tmp_path)) == want
    path = str(tmp_path / "saved")
    model.save(path)
    again = sax.SAXDictionary(words=5, order="seq").load_text(spark, path)
    assert key(again.predict(asked)) == want


@pytest.mark.parametrize("expire", [None, 45])
def test_delayed_lasso(spark, tmp_path, expire):
    rnd = np.random.default_rng(5)
    rows = [(i // 20, i, float(i % 20), float("nan") if i % 4 == 0 else float(rnd.normal()), float(rnd.normal())) for i in range(160)]
    told = [(c, c * 20 + 50, [1.0, 7.0, 15.0], rnd.normal(size=3).tolist()) for c in range(6)] + [(1, 95, [2.0], [4.0])]
    # two tables in files of the same ranges of seq
    spark.createDataFrame([], "a int").count()
    schemas = ("coil_id bigint, seq bigint, x double, f1 double, f2 double", "coil_id bigint, seq bigint, poses array<double>, labels array<double>")
    tables = [spark.createDataFrame(t, s) for t, s in zip((rows, told), schemas)]
    streams = []
    for n, df in enumerate(tables):
        for k in range(4):
            df.where(F.col("seq").between(40 * k, 40 * k + 39)).coalesce(1).write.parquet(f"{tmp_path}/in{n}/part={k}")
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in{n}"))
    how = {"features": ("f1", "f2"), "default": {"f1": 2.0}, "expire": expire}
    key = lambda d: sorted((r.idx, round(r.prediction, 8)) for r in d.where("kind = 'prediction'").collect())
    want = lasso.LassoDelayed(bundles=tables[1], **how).transform(tables[0])
    got = drained(spark, lasso.LassoDelayed(bundles=streams[1], **how).transform(streams[0]), tmp_path)
    assert key(got) == key(want) and len(key(want)) == 160
    model = lambda d: d.where("kind = 'model'").orderBy(F.desc("seq")).first().state
    assert np.allclose(model(got), model(want), atol=1e-8)


@pytest.mark.parametrize("expire", [None, 5])
def test_prequential(spark, sf_dir, live, tmp_path, expire):
    log = T.event_log(spark, sf_dir, delay=3).where("model_key = 'view'")
    how = online.Prequential(learner=online.Ridge(), features=2, expire=expire)
    key = lambda d: sorted((r.seq, round(r.prediction, 8)) for r in d.where("kind = 'prediction'").collect())
    assert key(drained(spark, how.transform(live(log)), tmp_path)) == key(how.transform(log))


def test_a_stream_starts_from_a_saved_model(spark, sf_dir, live, tmp_path):
    log = T.event_log(spark, sf_dir)
    saved = spark.createDataFrame([("view", [0.4, 0.2])], "model_key string, state array<double>")
    how = online.Prequential(learner=online.NormalisedLMS(), features=2, initial=saved)
    key = lambda d: sorted((r.model_key, r.seq, round(r.prediction, 9)) for r in d.where("kind = 'prediction'").collect())
    assert key(drained(spark, how.transform(live(log)), tmp_path)) == key(how.transform(log))
