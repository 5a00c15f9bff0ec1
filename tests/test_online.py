import numpy as np
import pytest

from streamlearn.operators import lasso
from streamlearn.operators import online as O
from streamlearn.sources import tables as T

LOG = "model_key int, seq bigint, kind string, idx bigint, features array<double>, label double"
X, Y = [[1.0, 0.0], [1.0, 1.0], [0.5, -1.0]], [1.0, -1.0, 1.0]


def toy(spark):
    rows = []
    for i, (x, y) in enumerate(zip(X, Y)):
        rows += [(0, 2 * i, "x", i, x, None), (0, 2 * i + 1, "y", i, None, y)]
    return spark.createDataFrame(rows, LOG)


def run(spark, learner, log=None):
    out = O.Prequential(learner=learner, features=2).transform(toy(spark) if log is None else log).collect()
    predictions = [r.prediction for r in sorted((r for r in out if r.kind == "prediction"), key=lambda r: r.seq)]
    return predictions, [r.model for r in out if r.kind == "model"][0]


@pytest.mark.parametrize(
    ("learner", "predictions", "model"),
    [
        (O.Aggregating(), [0, 0.2, 0.3684210526], [3.25, 0.5, 0.5, 3, 0.5, -2]),
        (O.Ridge(), [0, 0.5, 0.7], [3.25, 0.5, 0.5, 3, 0.5, -2]),
        (O.NormalisedLMS(), [0, 0.5, 0.5], [0.1111111111, -0.7222222222]),
        (O.Lasso(gamma=4.0), [0, 0.4, 0.4090909091], [4.75, 0.5, 0.5, 4.5, 0.5, -2]),
        (O.PassiveAggressive("plain", loss="hinge"), [0, 1, 1], [-0.4142135624, -1.4142135624]),
        (O.PassiveAggressive("I", loss="hinge"), [0, 1, 1], [0.2236067977, -0.9472135955]),
        (O.PassiveAggressive("II", loss="hinge"), [0, 1, 1], [-0.0176062789, -0.8287484729]),
        (O.PassiveAggressive("plain"), None, [-1.1213203436, -1.6213203436]),
        (O.PassiveAggressive("I"), None, [0.6118033989, -0.2236067977]),
        (O.PassiveAggressive("II"), None, [-0.2855339059, -0.5355339059]),
        (O.OnlineSVM(), [0, 1, 0], [0.0833333333, -0.3333333333, 0.8333333333]),
        (O.OnlineSVM(margin="affine"), [0, 1, 1], [0.0833333333, -0.3333333333, 0.8333333333]),
        (O.Shrinking(a=0.0), [0.1, 0.1666666667, 0], [0, 0]),
        (O.Shrinking(a=0.0, competitive=True), [0.0833333333, 0.1333333333, 0], [0, 0]),
    ],
)
def test_goldens(spark, learner, predictions, model):
    got, end = run(spark, learner)
    if predictions is not None:
        assert np.allclose(got, predictions, atol=1e-9)
    assert np.allclose(end, model, atol=1e-9)


def test_labels_act_on_later_events_only(spark):
    rows = [(0, 0, "x", 0, [1.0, 0.0], None), (0, 1, "x", 1, [1.0, 0.0], None), (0, 2, "y", 0, None, 1.0), (0, 3, "x", 2, [1.0, 0.0], None), (0, 4, "y", 0, None, 9.0), (0, 5, "y", 7, None, 9.0), (0, 6, "x", 3, [1.0, 0.0], None)]
    got, end = run(spark, O.Ridge(), spark.createDataFrame(rows, LOG))
    assert got == [0, 0, 0.5, 0.5] and end[4:] == [1.0, 0.0]  # the second label of 0 and that of 7 have no features
    with pytest.raises(Exception, match="before its features"):
        O.Prequential(learner=O.Ridge(), features=2, on_missing="error").transform(spark.createDataFrame(rows, LOG)).collect()


def test_a_repeated_index_overwrites(spark):
    rows = [(0, 0, "x", 0, [1.0, 0.0], None), (0, 1, "x", 0, [0.0, 1.0], None), (0, 2, "y", 0, None, 2.0)]
    assert run(spark, O.Ridge(), spark.createDataFrame(rows, LOG))[1] == [1, 0, 0, 2, 0, 2]


def test_blocks_equal_steps():
    rng = np.random.default_rng(0)
    x, y, is_x = rng.normal(size=(500, 3)), rng.normal(size=500), rng.random(500) < 0.5
    for learner in (O.Ridge(), O.Aggregating(), O.Lasso(gamma=2.0), O.Ridge(a=0.0)):
        model, want = learner.start(3), []
        for k in range(500):
            if is_x[k]:
                want.append(learner.predict(model, x[k]))
            else:
                model = learner.update(model, x[k], y[k], k)
        end, got = learner.block(learner.start(3), x, is_x, y, size=64)
        assert np.allclose(got, want, atol=1e-6) and np.allclose(learner.values(end), learner.values(model))


def test_closed_form_is_the_fold(spark, sf_dir):
    log = T.event_log(spark, sf_dir)
    ends = {r.model_key: r.model for r in O.Prequential(learner=O.Ridge(), features=2).transform(log).where("kind = 'model'").collect()}
    for r in O.additive_model(O.paired(log).where("kind = 'y'"), 2, keys=["model_key"]).collect():
        assert np.allclose([r.a00, r.a01, r.a10, r.a11, r.b0, r.b1], ends[r.model_key])


def test_shrinking_follows_its_formula():
    rng = np.random.default_rng(3)
    m = O.Shrinking(penalty=0.5)
    model, a, b, w = m.start(2), np.eye(2), np.zeros(2), np.full(2, 0.1)
    for _ in range(20):
        x, y = rng.normal(size=2), rng.normal()
        model = m.update(model, x, y, 0)
        d = np.diag(np.sqrt(np.abs(w)))
        a, b = a + np.outer(x, x), b + y * x
        w = d @ np.linalg.pinv(0.5 * np.eye(2) + d @ a @ d) @ d @ b
        assert np.allclose(model[2], w)


def test_shrinking_steps_need_no_decomposition(monkeypatch):
    rng, pinv = np.random.default_rng(2), np.linalg.pinv
    for n in (1, 2, 3):
        for m in (rng.normal(size=(n, n)), np.ones((n, n)), np.zeros((n, n)), np.diag([1.0, 1e-17, 1.0][:n])):
            assert np.allclose(O.inverse(m), pinv(m))
    monkeypatch.setattr(np.linalg, "pinv", None)
    for n in (2, 3):
        m = O.Shrinking(competitive=True)
        model = m.start(n)
        for x in rng.normal(size=(20, n)):
            m.predict(model, x)
            model = m.update(model, x, 1.0, 0)


def test_bad_names():
    with pytest.raises(ValueError):
        O.PassiveAggressive("III")
    with pytest.raises(ValueError):
        O.OnlineSVM(margin="none")


def test_zero_vector_updates_nothing():
    w = np.array([0.5, 0.5])
    assert (O.PassiveAggressive().update(w, np.zeros(2), 1.0, 0) == w).all()


@pytest.mark.parametrize("variant", O.VARIANTS)
def test_steps_add_as_sql_does_to_the_last_bit(variant):
    rng, m = np.random.default_rng(5), O.PassiveAggressive(variant, loss="hinge")
    w, (u, v) = m.start(2), (0.0, 0.0)
    for p, q, y in zip(rng.normal(size=3000).tolist(), rng.normal(size=3000).tolist(), rng.choice([-1.0, 1.0], 3000).tolist()):
        x = np.array([p, q])
        assert m.predict(w, x) == (u * p + v * q > 0) - (u * p + v * q < 0)
        loss, size = max(0.0, 1.0 - y * (u * p + v * q)), (p * p + q * q) ** 0.5
        rate = {"plain": loss / size, "I": min(loss / size, 0.5), "II": loss / (size + 1.0)}[variant]
        w, u, v = m.update(w, x, y, 0), u + rate * y * p, v + rate * y * q
        assert w.tolist() == [u, v]


def test_zero_vectors_in_plain_steps_follow_the_formula_or_are_skipped():
    x, w = np.array([1.0, 1.0]), np.array([0.5, 0.5])
    after = O.PassiveAggressive("plain").update(w, np.zeros(2), 1.0, 0)
    assert np.isnan(after).all() and O.PassiveAggressive("plain").predict(after, x) == 0
    assert np.isnan(O.PassiveAggressive("plain").update(after, x, 1.0, 0)).all()
    assert (O.PassiveAggressive("II").update(w, np.zeros(2), 1.0, 0) == w).all()
    assert (O.PassiveAggressive("plain", zero="skip").update(w, np.zeros(2), 1.0, 0) == w).all()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    log = T.event_log(spark, sf_dir).where("seq < 400")
    for k in range(4):  # files by time: order holds over micro-batches
        log.where(f"seq >= {100 * k} AND seq < {100 * (k + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    how = O.Prequential(learner=O.OnlineSVM(), features=2)
    T.drain(how.transform(live), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    key = lambda df: sorted((r.model_key, r.seq, r.prediction) for r in df.where("kind = 'prediction'").collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(how.transform(log))


def test_flatness_goldens(spark):
    labels = spark.createDataFrame([(0, n, x, y) for n, (x, y) in enumerate([(1.11, 1.55), (2.22, 2.44), (3.33, 3.33), (4.44, 4.22), (5.55, 5.11)])] + [(1, 0, 3.0, 7.0)], "coil_id bigint, label_no bigint, x double, value double")
    at = [2.33, 4.55, 1.21, 12.23, 49.02]
    rows = spark.createDataFrame([(0, n, x) for n, x in enumerate(at)] + [(1, 10, 9.0), (2, 11, 9.0), (0, 12, None)], "coil_id bigint, row_id bigint, x double")
    out = {r.row_id: r.flatness for r in lasso.flatness_map(rows, labels).collect()}
    assert np.allclose([out[n] for n in range(5)], [2.528198198198198, 4.308198198, 1.630180180, 10.466036036, 39.964324324])
    assert out[10] == 7.0 and out[11] is None and out[12] is None


def test_flatness_is_the_plain_search(spark):
    rng = np.random.default_rng(8)
    labels = [(int(rng.integers(0, 4)), n, float(rng.integers(0, 30)), float(rng.normal())) for n in range(60)]
    rows = [(int(rng.integers(0, 4)), n, float(rng.integers(-5, 70)) / 2) for n in range(200)]
    out = {r.row_id: r.flatness for r in lasso.flatness_map(spark.createDataFrame(rows, "coil_id bigint, row_id bigint, x double"), spark.createDataFrame(labels, "coil_id bigint, label_no bigint, x double, value double")).collect()}
    for c, n, x in rows:
        (p1, v1), (p2, v2) = [(a[2], a[3]) for a in sorted((l for l in labels if l[0] == c), key=lambda l: (abs(l[2] - x), l[1]))[:2]]
        want = v1 if p1 == p2 else v1 + (x - p1) * (v2 - v1) / (p2 - p1)
        assert abs(out[n] - want) < 1e-9


def test_lasso_delayed_is_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(c, 10 * c + k, float(k), float(rng.normal()) if rng.random() < 0.7 else float("nan"), float(rng.normal())) for c in range(6) for k in range(8)]
    bundles = [(c, 10 * c + 14, [0.5, 3.0, 6.5], rng.normal(size=3).tolist()) for c in range(6)]
    df = spark.createDataFrame(rows, "coil_id bigint, seq bigint, x double, f1 double, f2 double")
    b = spark.createDataFrame(bundles, "coil_id bigint, seq bigint, poses array<double>, labels array<double>")
    got = {r.idx: r.prediction for r in lasso.LassoDelayed(features=("f1", "f2"), bundles=b, default={"f1": 2.0}).transform(df).where("kind = 'prediction'").collect()}
    a, v, last, filled = np.eye(2), np.zeros(2), 2.0, {}
    events = sorted([(r[1], 0, r) for r in rows] + [(x[1], 1, x) for x in bundles], key=lambda e: e[:2])
    for seq, kind, e in events:
        if kind == 0:
            last = last if np.isnan(e[3]) else e[3]
            filled[seq] = (e[0], e[2], np.array([last, e[4]]))
            assert abs(got[seq] - v @ np.linalg.solve(a, filled[seq][2])) < 1e-9
        else:
            for s in sorted(filled):
                c, x, f = filled[s]
                if c == e[0] and s < seq:
                    (p1, v1), (p2, v2) = sorted(zip(e[2], e[3]), key=lambda z: abs(z[0] - x))[:2]
                    a, v = a + np.outer(f, f) + np.eye(2), v + (v1 + (x - p1) * (v2 - v1) / (p2 - p1)) * f


def test_impute_by_coil_and_defaults(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1, nan), (1, 2, 5.0), (0, 3, nan), (1, 4, nan)], "coil bigint, seq bigint, f double")
    values = lambda out: [r.f for r in out.orderBy("seq").collect()]
    assert values(lasso.impute(df, ["f"], default={"f": 9.0})) == [9.0, 5.0, 5.0, 5.0]
    assert values(lasso.impute(df, ["f"], by=["coil"], default={"f": 9.0})) == [9.0, 5.0, 9.0, 5.0]
    assert T.SENSOR_DEFAULTS[26] == 1.846


def test_sensor_rows_keep_their_order_after_a_million(spark, monkeypatch):
    from pyspark.sql import functions as F

    from streamlearn.plans import catalogue

    events = spark.createDataFrame([(i, float(i % 7), i % 5) for i in (*range(80), *range(1_000_000, 1_000_080))], "event_id bigint, value double, user_id bigint")
    monkeypatch.setattr(catalogue.T, "table", lambda spark, d, name: events)
    rows, bundles = catalogue._sensors(spark, "")
    assert rows.select("seq").distinct().count() == 160
    late = rows.join(bundles.select("coil_id", F.col("seq").alias("labelled")), "coil_id").where("labelled > seq + 60 or labelled <= seq")
    assert late.count() == 0


LEARNERS = [
    (O.Ridge(), False), (O.Aggregating(), False), (O.Lasso(gamma=4.0), False), (O.Ridge(a=0.0), False), (O.Shrinking(penalty=[[0.5, 0.1], [0.1, 0.5]]), False),
    (O.Shrinking(competitive=True), False), (O.NormalisedLMS(), False), (O.PassiveAggressive("II", loss="hinge"), True), (O.OnlineSVM(), True), (O.AdaptiveSVM(), True),
]


@pytest.mark.parametrize(("learner", "classes"), LEARNERS)
def test_learning_goes_on_from_saved_models(spark, sf_dir, learner, classes):
    log = T.event_log(spark, sf_dir, delay=0, classes=classes)
    run = lambda rows, **how: O.Prequential(learner=learner, features=2, **how).transform(rows)
    key = lambda d: sorted((r.model_key, r.seq, r.prediction) for r in d.where("kind = 'prediction'").collect())
    whole = run(log)
    models = run(log.where("seq < 900")).where("kind = 'model'").select("model_key", "state")
    models = spark.createDataFrame(models.collect(), models.schema)  # saved
    rest = [r for r in key(whole) if r[1] >= 900]
    got = key(run(log.where("seq >= 900"), initial=models))
    assert [r[:2] for r in got] == [r[:2] for r in rest] and np.allclose([r[2] for r in got], [r[2] for r in rest], atol=1e-9)
    # and saved models predict by themselves, broadcast or joined
    rows = log.where("kind = 'x'").select("model_key", "idx", "features")
    want = {(r.model_key, r.idx): r.prediction for r in O.Prequential(learner=learner, features=2, initial=models).transform(log.where("kind = 'x'")).where("kind = 'prediction'").collect()}
    for most in (10_000, 0):
        O.MAX_MODELS, old = most, O.MAX_MODELS
        try:
            found = {(r.model_key, r.idx): r.prediction for r in O.predict(learner, models, rows, 2).collect()}
        finally:
            O.MAX_MODELS = old
        assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()), atol=1e-9)


def test_rows_without_a_model_get_no_prediction(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0]), (None, [0.0, 0.0])], "model_key string, features array<double>")
    models = spark.createDataFrame([("a", [0.5, 0.25])], "model_key string, state array<double>")
    assert {r.model_key: r.prediction for r in O.predict(O.NormalisedLMS(), models, rows, 2).collect()} == {"a": 1.0, "b": None, None: None}


def test_waiting_features_expire(spark):
    rows = [(0, 0, "x", 0, [1.0, 0.0], None), (0, 5, "x", 1, [0.0, 1.0], None), (0, 10, "y", 0, None, 1.0), (0, 11, "y", 1, None, 2.0)]
    how = O.Prequential(learner=O.Ridge(), features=2, expire=6)
    (end,) = [r.model for r in how.transform(spark.createDataFrame(rows, LOG)).collect() if r.kind == "model"]
    assert end == [1, 0, 0, 2, 0, 2]  # the first label came too late
    waiting = O._Unpaired(O.Ridge(), 2, "ignore", 6)
    import pandas as pd

    state, _ = waiting.block(waiting.start(), pd.DataFrame(rows, columns=["model_key", "seq", "kind", "idx", "features", "label"]))
    assert state[1] == {}


def test_many_features(spark):
    """76 features: blocks of matrices stay small."""
    rnd = np.random.default_rng(1)
    x, w = rnd.normal(size=(300, 76)), rnd.normal(size=76)
    learner, model, seen = O.Ridge(), O.Ridge().start(76), []
    for row in x:
        seen.append(learner.predict(model, row))
        model = learner.update(model, row, float(row @ w), 0)
    both = np.repeat(x, 2, axis=0)
    is_x = np.arange(600) % 2 == 0
    end, p = learner.block(learner.start(76), both, is_x, np.repeat(x @ w, 2))
    assert np.allclose(p, seen, atol=1e-6) and np.allclose(end[0], model[0])


@pytest.mark.parametrize("saved", [None, [3.0, 0.5, 0.5, 2.0, 1.0, -1.0]])
def test_a_key_of_an_additive_learner_spans_tasks(spark, saved):
    rng = np.random.default_rng(9)
    x, y, m = rng.normal(size=(600, 2)), rng.normal(size=600), O.Lasso(gamma=4.0)
    rows = [r for i in range(600) for r in ((7, 2 * i, "x", i, x[i].tolist(), None), (7, 2 * i + 1, "y", i, None, float(y[i])))]
    initial = None if saved is None else spark.createDataFrame([(7, saved), (8, saved)], "model_key int, state array<double>")
    out = O.Prequential(learner=m, features=2, initial=initial).transform(spark.createDataFrame(rows, LOG))
    model, want = m.start(2) if saved is None else m.load(saved, 2), []
    for i in range(600):
        want.append(m.predict(model, x[i]))
        model = m.update(model, x[i], y[i], i)
    got = out.orderBy("seq").collect()
    assert np.allclose([r.prediction for r in got if r.kind == "prediction"], want)
    (end,) = [r for r in got if r.kind == "model"]
    assert end.seq == 1199 and np.allclose(end.model, m.values(model))
    assert "RepartitionByExpression [model_key" not in out._jdf.queryExecution().optimizedPlan().toString()
