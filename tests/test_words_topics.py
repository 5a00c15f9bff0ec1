import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlearn.base import Mapped, Pipeline, Transformer
from streamlearn.operators import evaluation, sax, topics
from streamlearn.sources import tables as T

VALUES = [float(v) for v in (2, 3, 4, 8, 8, 9, 8, 6, 6, 5, 5, 5, 6, 2, 1)]


def series(spark, values, keys=1):
    return spark.createDataFrame([(k, i, v) for k in range(keys) for i, v in enumerate(values)], "key int, seq bigint, value double")


def test_fit_goldens(spark):
    s = sax.SAX().fit(series(spark, VALUES))
    assert abs(s.fitted[0] - 5.2) < 1e-12 and abs(s.fitted[1] - 2.372059583287625) < 1e-9
    s = sax.SAX().fit(series(spark, [0.0, 1.0, 2.0, 3.0, 4.0]))
    assert s.fitted[0] == 2.0 and abs(s.fitted[1] - np.std(range(5))) < 1e-12


def test_word_goldens(spark):
    data = series(spark, VALUES, keys=2)
    s = sax.SAX(paa=3, word=1, alphabet=2).fit(series(spark, VALUES))
    for k in (0, 1):
        assert [r.word for r in s.transform(data).where(F.col("key") == k).orderBy("word_no").collect()] == ["a", "b", "b", "a", "a"]
    out = s.with_params(paa=2, word=2).transform(series(spark, VALUES[:12])).orderBy("word_no").collect()
    assert [r.word for r in out] == ["ab", "bb", "ba"]
    assert s.with_params(paa=4, word=2).transform(series(spark, VALUES)).count() == 1  # what is incomplete is dropped


def test_unfitted_and_bad_alphabets(spark):
    with pytest.raises(RuntimeError):
        sax.SAX().transform(series(spark, VALUES))
    for n in (1, 11):
        with pytest.raises(ValueError):
            sax.cuts(n)
    assert sax.cuts(4) == [-0.6744898, 0.0, 0.6744898] and len(sax.cuts(10)) == 9
    assert sax.distance_matrix(2) == [[0, 0], [0, 0]]
    assert sax.SAX().load(1.0, 2.0).fitted == (1.0, 2.0)


def labelled(spark, *rows):
    return spark.createDataFrame(rows, "class string, word string")


WORDS = [("A", w) for w in ("aa", "bb", "cc")] + [("B", w) for w in ("dd", "ee", "ff")]


def asked(spark, words):
    return spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "key int, word_no bigint, word string")


def test_dictionary_goldens(spark):
    d = sax.SAXDictionary(words=3).fit(labelled(spark, *WORDS))
    assert abs(d.table.where("word = 'aa'").first().tfidf - 1.1736001944781467) < 1e-12
    got = d.predict(asked(spark, "aa bb cc aa bb dd aa ee ff dd ee ff".split())).orderBy("window_no").collect()
    assert [r["class"] for r in got] == ["A", "A", "B", "B"]
    assert np.allclose([r.similarity for r in got], [1, 2 / 3, 2 / 3, 1])
    none = d.predict(asked(spark, ["zz"] * 3)).first()
    assert none["class"] == "A" and none.similarity == 0
    assert d.max_words() == 6 and d.recommended_words() == 3


def test_ties_keep_their_own_similarity_and_are_scored_once(spark):
    # A's similarity is 1 - 1.25e-13: a tie at twelve digits, which A wins with its own value
    table = spark.createDataFrame([("A", "aa", 1, 1.0), ("A", "bb", 1, 1.0 + 1e-6), ("B", "aa", 1, 1.0), ("B", "bb", 1, 1.0)], "class string, word string, freq bigint, tfidf double")
    found = sax.SAXDictionary(words=2).with_table(table).predict(asked(spark, ["aa", "bb"]))
    got = found.first()
    assert got["class"] == "A" and 0 < 1 - got.similarity < 5e-13
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, (word") == 1


def test_refit_replaces_and_adds(spark, tmp_path):
    d = sax.SAXDictionary().fit(labelled(spark, *WORDS)).fit(labelled(spark, ("B", "aa"), ("C", "gg")))
    assert sorted((r["class"], r.word) for r in d.table.collect()) == [("A", "aa"), ("A", "bb"), ("A", "cc"), ("B", "aa"), ("C", "gg")]
    # three classes, a word in two of them: floor(3 / 2) = 1
    assert abs(d.table.where("word = 'aa'").first().tfidf - np.log(2)) < 1e-12
    d.save(f"{tmp_path}/d")
    back = sax.SAXDictionary().load(spark, f"{tmp_path}/d")
    key = lambda t: sorted(map(tuple, t.select("class", "word", "freq", "tfidf").collect()))
    assert key(back.table) == key(d.table)
    assert sax.load_weights(spark, f"{tmp_path}/d").count() == 5
    with pytest.raises(RuntimeError):
        sax.SAXDictionary().predict(asked(spark, ["aa"]))


def test_linked(spark):
    s = sax.SAX(paa=2, word=1, alphabet=2).fit(series(spark, VALUES[:12]))
    words = s.transform(series(spark, VALUES[:12])).select(F.lit("A").alias("class"), "word")
    chain = Pipeline([s, sax.SAXDictionary(words=2).fit(words)])
    assert chain.predict(series(spark, VALUES[:12])).count() == 3
    assert s.then(sax.SAXDictionary(words=2).fit(words)).predict(series(spark, VALUES[:12])).count() == 3


def test_word_stream_equals_batch(spark, sf_dir, tmp_path):
    data = T.event_series(spark, sf_dir)
    for k in range(3):
        data.where(f"seq % 1000 >= {334 * k} AND seq % 1000 < {334 * (k + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = sax.SAX(paa=3, word=2, alphabet=4).fit(data)
    T.drain(s.transform(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    key = lambda df: sorted((r.key, r.word_no, r.word) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(s.transform(data))


def test_pipelines_and_parameters(spark):
    class Doubled(Transformer):
        defaults = {"by": 2}

        def _transform(self, df, p):
            return df.withColumn("value", F.col("value") * p["by"])

    df = series(spark, [1.0, 2.0])
    both = Doubled(by=3).then(Doubled()).then(Mapped(lambda d: d["value"] + 1))
    assert [r.prediction for r in both.fit(df).predict(df).orderBy("seq").collect()] == [7, 13]
    assert Doubled().transform(df, by=5).orderBy("seq").first().value == 5
    with pytest.raises(ValueError, match="no parameter"):
        Doubled(of=1)
    with pytest.raises(NotImplementedError):
        Doubled().predict(df)
    with pytest.raises(NotImplementedError):
        Transformer().transform(df)
    with pytest.raises(ValueError, match="missing"):
        sax.SAX().load(0, 1).transform(df.drop("value"))


def test_digamma():
    x = np.array([0.1, 0.5, 1.0, 2.5, 10.0, 100.0])
    h = 1e-5
    from math import lgamma

    want = [(lgamma(v + h) - lgamma(v - h)) / (2 * h) for v in x]
    assert np.allclose(topics.digamma(x), want, atol=1e-7)
    assert abs(topics.log_sum_exp(np.array([1000.0, 1000.0])) - 1000 - np.log(2)) < 1e-9


def test_topics_are_separated(spark):
    rng = np.random.default_rng(0)
    kinds = [[f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]]
    docs = spark.createDataFrame([(i, rng.choice(kinds[i % 2], 40).tolist()) for i in range(200)] + [(999, []), (998, None)], "doc_id bigint, tokens array<string>")
    model = topics.OnlineLDA(topics=2, words=50, batches=4, passes=4, offset=1.0).fit(docs)
    share = {r.topic: r.a for r in model.topics(spark).groupBy("topic").agg(F.sum(F.when(F.col("word").startswith("a"), F.col("weight")).otherwise(0)).alias("a")).collect()}
    assert sorted(round(v) for v in share.values()) == [0, 1] and max(abs(v - round(v)) for v in share.values()) < 0.1
    out = {r.doc_id: r.topics for r in model.predict(docs).collect()}
    assert np.argmax(out[0]) != np.argmax(out[1]) and np.allclose(out[999], 0.5)


def test_documents_in_step_equal_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    beta = np.exp(topics.dirichlet_expectation(rng.gamma(100.0, 0.01, (5, 300))))
    docs = [(np.sort(rng.choice(300, n, replace=False)), rng.integers(1, 9, n).astype("f8")) for n in (1, 3, 250, 40, 41, 7, 300, 2, 90, 1)]
    monkeypatch.setattr(topics, "BLOCK_NUMBERS", 5 * 300 * 2)
    seen = []
    for block, ids, gamma, stats in topics.infer_many(docs, beta, 0.2):
        for row, i in enumerate(block):
            want, sums = topics.infer(*docs[i], beta, 0.2)
            n = len(docs[i][0])
            assert (ids[row, :n] == docs[i][0]).all() and np.allclose(gamma[row], want) and np.allclose(stats[row, :, :n], sums) and not stats[row, :, n:].any()
        seen += block
    assert sorted(seen) == list(range(len(docs)))


def test_words_are_counted_in_their_rows(monkeypatch, spark):
    rows = [(1, ["b", "a", "b", None, None]), (2, []), (3, None), (4, ["", "a"])]
    schema, key = "doc_id bigint, tokens array<string>", lambda df: sorted(map(tuple, df.collect()), key=str)
    once = topics.token_counts(spark.createDataFrame(rows, schema))
    assert key(once) == sorted([(1, "a", 1), (1, "b", 2), (1, None, 2), (4, "", 1), (4, "a", 1)], key=str)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    more = spark.createDataFrame([*rows, (4, ["a"]), (None, ["a"]), (None, ["a", "c"])], schema)
    want = sorted([(1, "a", 1), (1, "b", 2), (1, None, 2), (4, "", 1), (4, "a", 2), (None, "a", 2), (None, "c", 1)], key=str)
    assert key(topics.token_counts(more)) == want
    assert key(topics.token_counts(more, ["c", "b"])) == sorted([(1, "b", 2), (None, "c", 1)], key=str)
    monkeypatch.setattr(topics, "MAX_AGAIN", 1)
    assert key(topics.token_counts(more)) == want


def test_metrics(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, -1.0), (-1.0, -1.0), (-1.0, 1.0), (2.0, 1.0), (None, 1.0)], "prediction double, label double")
    r = evaluation.confusion(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 1, 2)
    assert np.allclose([r.accuracy, r.precision, r.recall, r.fpr], [0.5, 2 / 3, 0.5, 0.5]) and abs(r.f - 4 / 7) < 1e-12
    old = evaluation.confusion(df, reference_metrics=True).first()
    assert old.precision == old.recall == 2 / 3
    only = evaluation.confusion(spark.createDataFrame([(-1.0, -1.0)], "prediction double, label double")).first()
    assert (only.precision, only.recall, only.fpr, only.f) == (1, 0, 0, 0)


def test_topics_query_is_the_whole_job(monkeypatch, spark, sf_dir):
    from streamlearn.operators import topics
    from streamlearn.plans import catalogue

    seen = []

    class Fitted:
        def topics(self, spark):
            return spark.createDataFrame([], "topic int, word string, weight double")

    monkeypatch.setattr(topics.OnlineLDA, "fit", lambda self, docs: seen.append(dict(self.params)) or Fitted())
    catalogue.QUERIES["lda_topics"](spark, sf_dir)
    assert [(p["topics"], p["words"], p["batches"]) for p in seen] == [(20, 10_000, 4)]
