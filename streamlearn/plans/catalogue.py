"""The library's queries, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import vector
from ..operators import evaluation, lasso, moments, online, pca, sampling, sax, sketch, topics
from ..sources import tables as T
from .shared import scratch, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- A. streaming statistics ------------------------------------------------------------------------------------

_LINES = "s AS (SELECT l_returnflag AS pid, l_quantity AS w, unnest([0, 1, 2])::INT AS feature, unnest([l_quantity / 7, l_extendedprice / 9973, l_discount / 0.7::DOUBLE]) AS x FROM lineitem)"
_EVENTS = "s AS (SELECT event_type AS pid, event_id AS seq, unnest([user_id % 5 + 1.0::DOUBLE, 2.0::DOUBLE]) AS w, unnest([0, 1])::INT AS feature, unnest([value / 97, ((event_id * 7) % 11) / 13.0::DOUBLE]) AS x FROM events)"
_ORDERED = "PARTITION BY pid, feature ORDER BY seq"


@query("moments_final", f"WITH {_LINES} SELECT pid, feature, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(var_samp(x), 6) + 0.0::DOUBLE AS variance FROM s GROUP BY pid, feature")
def moments_final(spark, d):
    return rounded(moments.MomentsEstimator(output="final").transform(T.lineitem_samples(spark, d)), "mean", "variance")


@query("moments_running", f"WITH {_EVENTS} SELECT pid, seq, feature, count(*) OVER w AS n, round(avg(x) OVER w, 6) + 0.0::DOUBLE AS mean, round(var_samp(x) OVER w, 6) + 0.0::DOUBLE AS variance FROM s WINDOW w AS ({_ORDERED})")
def moments_running(spark, d):
    return rounded(moments.MomentsEstimator().transform(T.event_samples(spark, d)), "mean", "variance")


@query("moments_merged", f"WITH {_LINES} SELECT feature, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(var_samp(x), 6) + 0.0::DOUBLE AS variance FROM s GROUP BY feature")
def moments_merged(spark, d):
    return rounded(moments.MomentsEstimator(output="merged").transform(T.lineitem_samples(spark, d)), "mean", "variance")


@query("moments_unkeyed", f"WITH {_EVENTS} SELECT feature, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(var_samp(x), 6) + 0.0::DOUBLE AS variance FROM s GROUP BY feature")
def moments_unkeyed(spark, d):
    """Events without a key are dealt to eight, whose models are merged."""
    parts = moments.MomentsEstimator(output="final", partitions=8).transform(T.event_samples(spark, d).drop("pid"))
    models = parts.select("feature", "n", "mean", (F.coalesce("variance", F.lit(0.0)) * (F.col("n") - 1)).alias("m2"))
    return rounded(moments.merge_moments(models), "mean", "variance")


@query("delimited_source", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(event_id) AS last FROM events GROUP BY event_type")
def delimited_source(spark, d):
    """Events written as delimited text and read with a given schema."""
    path = scratch(spark, "delimited")
    T.table(spark, d, "events").select("event_id", "event_type", "value").write.option("sep", ";").csv(path)
    rows = T.csv(spark, path, "event_id bigint, event_type string, value double")
    return rounded(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("event_id").alias("last")), "mean")


_WEIGHTED = "count(*) AS n, sum(w) AS weight, round(sum(w * x) / sum(w), 6) + 0.0::DOUBLE AS mean, round(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2, 6) + 0.0::DOUBLE AS variance"


@query("weighted_moments", f"WITH {_LINES} SELECT pid, feature, {_WEIGHTED} FROM s GROUP BY pid, feature")
def weighted_moments(spark, d):
    return rounded(moments.WeightedMomentsEstimator(output="final").transform(T.lineitem_samples(spark, d)), "mean", "variance")


@query("weighted_running", f"WITH {_EVENTS} SELECT pid, seq, feature, count(*) OVER o AS n, sum(w) OVER o AS weight, round(sum(w * x) OVER o / sum(w) OVER o, 6) + 0.0::DOUBLE AS mean, round(greatest(0.0::DOUBLE, sum(w * x * x) OVER o / sum(w) OVER o - (sum(w * x) OVER o / sum(w) OVER o) ^ 2), 6) + 0.0::DOUBLE AS variance FROM s WINDOW o AS ({_ORDERED})")
def weighted_running(spark, d):
    return rounded(moments.WeightedMomentsEstimator().transform(T.event_samples(spark, d)), "mean", "variance")


@query("weighted_merged", f"WITH {_LINES} SELECT feature, {_WEIGHTED} FROM s GROUP BY feature")
def weighted_merged(spark, d):
    parts = moments.WeightedMomentsEstimator(output="final").transform(T.lineitem_samples(spark, d))
    models = parts.select("feature", "n", "weight", "mean", (F.col("variance") * F.col("weight")).alias("m2"))
    return rounded(moments.merge_weighted(models), "mean", "variance")


@query(
    "ewm_running",
    f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT pid, seq, feature, x, row_number() OVER ({_ORDERED}) AS n FROM s),
    e AS (
      SELECT pid, seq, feature, n, 0.2::DOUBLE * x AS mean, 0.8::DOUBLE * x * (x - 0.2::DOUBLE * x) AS variance FROM o WHERE n = 1
      UNION ALL
      SELECT o.pid, o.seq, o.feature, o.n, 0.8::DOUBLE * e.mean + 0.2::DOUBLE * o.x,
        0.2::DOUBLE * e.variance + 0.8::DOUBLE * (o.x - e.mean) * (o.x - 0.8::DOUBLE * e.mean - 0.2::DOUBLE * o.x)
      FROM e JOIN o ON o.pid = e.pid AND o.feature = e.feature AND o.n = e.n + 1
    ) SELECT pid, seq, feature, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(variance, 6) + 0.0::DOUBLE AS variance FROM e""",
)
def ewm_running(spark, d):
    return rounded(moments.ExponentialMomentsEstimator(alpha=0.8).transform(T.event_samples(spark, d)), "mean", "variance")


@query(
    "moving_moments",
    f"""WITH {_EVENTS}, w AS (
      SELECT s.*, (floor(epoch(e.ts) / 21600) * 21600)::BIGINT - 21600 * unnest([0, 1, 2, 3]) AS start FROM s JOIN events e ON e.event_id = s.seq
    ) SELECT start, start + 86400 AS "end", pid, feature, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(var_pop(x), 6) + 0.0::DOUBLE AS variance
    FROM w GROUP BY start, pid, feature""",
)
def moving_moments(spark, d):
    out = moments.MovingMomentsEstimator(length="24 hours", slide="6 hours").transform(T.event_samples(spark, d))
    zero = F.lit("1970-01-01 00:00:00").cast(out.schema["start"].dataType)
    seconds = lambda c: F.timestamp_diff("SECOND", zero, c)
    return rounded(out.withColumns({"start": seconds(F.col("start")), "end": seconds(F.col("end"))}), "mean", "variance")


# --- B. sampling ------------------------------------------------------------------------------------------------

_U = "((event_id * 7919) % 10007 + 1) / 10008.0::DOUBLE"
_LOG = f"""n AS (SELECT event_type AS pid, event_id AS seq, value, {_U} AS u, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events),
  l AS (SELECT pid, seq, value, u, CASE WHEN n < 10 THEN n ELSE floor(u * (n + 1))::BIGINT END AS slot FROM n)"""


def _draws(spark, d):
    t = T.table(spark, d, "events")
    return t.select(F.col("event_type").alias("pid"), F.col("event_id").alias("seq"), "value", (((F.col("event_id") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("u"))


@query("reservoir_log", f"WITH {_LOG} SELECT pid, seq, value, slot FROM l WHERE slot < 10")
def reservoir_log(spark, d):
    return sampling.SimpleReservoirSampling(k=10, uniform="u").transform(_draws(spark, d)).drop("u")


@query("reservoir", f"WITH {_LOG} SELECT pid, slot, max_by(seq, seq) AS seq, max_by(value, seq) AS value FROM l WHERE slot < 10 GROUP BY pid, slot")
def reservoir(spark, d):
    return sampling.SimpleReservoirSampling(k=10, uniform="u", output="reservoir").transform(_draws(spark, d)).drop("u")


@query("weighted_reservoir", f"SELECT pid, seq, value, rank FROM (SELECT event_type AS pid, event_id AS seq, value, row_number() OVER (PARTITION BY event_type ORDER BY pow({_U}, 1.0::DOUBLE / value) DESC, event_id)::INT AS rank FROM events WHERE value > 0) WHERE rank <= 4")
def weighted_reservoir(spark, d):
    return sampling.WeightedReservoirSampling(k=4, uniform="u", weight="value").transform(_draws(spark, d)).select("pid", "seq", "value", "rank")


_CHOOSE = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"


def _hyper(x: str) -> str:
    """P(x old among 9 of 8 old and m new)."""
    parts = [_CHOOSE.format(a=a, b=b) for a, b in (("8", x), ("m", f"(9 - {x})"), ("(8 + m)", "9"))]
    return f"exp({parts[0]} + {parts[1]} - {parts[2]})"


@query(
    "adaptive_reservoir",
    f"""WITH RECURSIVE e AS (SELECT event_type AS pid, event_id AS seq, {_U} AS u, ((event_id * 104729) % 10009 + 1) / 10010.0::DOUBLE AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
      least AS (SELECT min(m) AS m FROM (SELECT m, sum({_hyper("x")}) AS c FROM (SELECT unnest(range(1, 2000)) AS m) CROSS JOIN (SELECT unnest(range(0, 5)) AS x) WHERE x <= 9 AND 9 - x <= m GROUP BY m) WHERE c >= 0.9),
      law AS (SELECT any_value(m) AS m, greatest(0, 9 - any_value(m)) AS low, list(c ORDER BY x) AS cdf FROM (SELECT m, x, sum({_hyper("x")}) OVER (ORDER BY x) AS c FROM least CROSS JOIN (SELECT unnest(range(0, 9)) AS x) WHERE 9 - x <= m)),
      r AS (SELECT pid, 0::BIGINT AS n, []::STRUCT(v DOUBLE, s BIGINT)[] AS held, 0::BIGINT AS rest, 0::BIGINT AS want FROM (SELECT DISTINCT pid FROM e)
        UNION ALL
        SELECT pid, n, CASE WHEN rest > 0 THEN CASE WHEN v * rest < want THEN list_append(held, z) ELSE held END WHEN len(held) < k THEN list_append(held, z) WHEN j < k THEN held[1:j] || [z] || held[j + 2:] ELSE held END,
          greatest(rest - 1, 0), want - CASE WHEN rest > 0 AND v * rest < want THEN 1 ELSE 0 END
        FROM (SELECT pid, n, u, v, {{'v': v, 's': seq}} AS z, floor(u * n)::BIGINT AS j, CASE WHEN n > 8 THEN 9 ELSE 4 END AS k,
            CASE WHEN n = 9 THEN list_filter(held, lambda h: list_contains(list_sort(held)[1:keep], h)) ELSE held END AS held, CASE WHEN n = 9 THEN m ELSE rest END AS rest, CASE WHEN n = 9 THEN 9 - keep ELSE want END AS want
          FROM (SELECT r.pid, e.n, e.seq, e.u, e.v, r.held, r.rest, r.want, law.m, least(greatest(low + len(list_filter(cdf, lambda c: c <= e.u)), 9 - law.m), len(r.held))::BIGINT AS keep FROM r JOIN e ON e.pid = r.pid AND e.n = r.n + 1 CROSS JOIN law)))
      SELECT pid, 9 AS size, unnest(range(0, len(held)))::INT AS slot, unnest(list_transform(held, lambda h: h.s)) AS member FROM r QUALIFY n = max(n) OVER (PARTITION BY pid)""",
)
def adaptive_reservoir(spark, d):
    rows = _draws(spark, d).withColumn("v", ((F.col("seq") * 104729) % 10009 + 1) / F.lit(10010.0))
    out = sampling.AdaptiveReservoirSampling(k=4, change=9, threshold=0.9, uniform=("u", "v")).transform(rows)
    return out.select("pid", "size", F.posexplode("members").alias("slot", "member"))


# --- C. sketches, components, anomaly ---------------------------------------------------------------------------


_VECTORS = "x AS (SELECT vec_id % 4 AS pid, vec_id AS seq, list_transform(embedding, lambda e: e::DOUBLE) AS u FROM embeddings)"


def _energy(rows: DataFrame, *keys: str) -> DataFrame:
    """Sum of squares of each column, by keys."""
    return rows.select(*keys, F.posexplode("data").alias("j", "v")).groupBy(*keys, "j").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def _kept(rows: DataFrame, sketch: DataFrame, bound: float, *keys: str) -> DataFrame:
    """Each column's sum of squares, and whether the sketch has no more and lacks at most `bound` of the whole sum."""
    whole = _energy(rows, *keys)
    total = whole.groupBy(*keys).agg(F.sum("energy").alias("total")) if keys else whole.agg(F.sum("energy").alias("total")).withColumn("all", F.lit(0))
    on = list(keys) or ["all"]
    both = (whole if keys else whole.withColumn("all", F.lit(0))).join(total, on).join(_energy(sketch, *keys).withColumnRenamed("energy", "own"), [*keys, "j"], "left")
    gap = F.col("energy") - F.coalesce("own", F.lit(0.0))
    return both.select(*keys, "j", r6("energy").alias("energy"), ((gap >= -1e-9 * F.col("total")) & (gap <= bound * F.col("total"))).alias("held"))


_ENERGY = f"WITH {_VECTORS}, e AS (SELECT pid, unnest(range(0, len(u)))::INT AS j, unnest(u) AS v FROM x)"


@query("fd_sketch", f"{_ENERGY} SELECT pid::INT AS pid, j, round(sum(v * v), 6) + 0.0::DOUBLE AS energy, true AS held FROM e GROUP BY pid, j")
def fd_sketch(spark, d):
    v = T.vectors(spark, d)
    return _kept(v, sketch.FrequentDirections(ell=16).transform(v), 2 / 16, "pid")


@query("fd_merged", f"{_ENERGY} SELECT j, round(sum(v * v), 6) + 0.0::DOUBLE AS energy, true AS held FROM e GROUP BY j")
def fd_merged(spark, d):
    v = T.vectors(spark, d)
    return _kept(v, sketch.FrequentDirections(ell=16, aggregate=True).transform(v), 3 * 2 / 16)


@query("ad_sketch", f"{_ENERGY} SELECT pid::INT AS pid, j, round(sum(v * v), 6) + 0.0::DOUBLE AS energy, true AS held FROM e GROUP BY pid, j")
def ad_sketch(spark, d):
    v = T.vectors(spark, d)
    return _kept(v, sketch.AnomalySketch(ell=16).transform(v), 1 / 16, "pid")


@query(
    "fd_small",  # two rows: the decomposition has a closed form; signs of directions do not matter to the products
    f"""WITH RECURSIVE {_VECTORS}, o AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq) AS t FROM x),
      s AS (SELECT a.pid, 2::BIGINT AS t, a.u AS a, b.u AS b FROM o a JOIN o b ON b.pid = a.pid AND b.t = 2 WHERE a.t = 1
        UNION ALL
        SELECT pid, t, list_transform(list_zip(a, b), lambda z: scale * (cos(turn) * z[1] + sin(turn) * z[2])), u
        FROM (SELECT pid, t, a, b, u, atan2(2 * ab, aa - bb) / 2 AS turn, sqrt(gap / ((aa + bb + gap) / 2)) AS scale
          FROM (SELECT *, sqrt((aa - bb) ^ 2 + 4 * ab ^ 2) AS gap FROM (SELECT s.pid, o.t, s.a, s.b, o.u, list_dot_product(s.a, s.a) AS aa, list_dot_product(s.b, s.b) AS bb, list_dot_product(s.a, s.b) AS ab FROM s JOIN o ON o.pid = s.pid AND o.t = s.t + 1)))),
      f AS (SELECT * FROM s QUALIFY t = max(t) OVER (PARTITION BY pid))
      SELECT pid::INT AS pid, j::INT AS j, round(a[j + 1] * a[j + 1] + b[j + 1] * b[j + 1], 6) + 0.0::DOUBLE AS own, round(a[j + 1] * a[1] + b[j + 1] * b[1], 6) + 0.0::DOUBLE AS with_first FROM (SELECT *, unnest(range(0, len(a))) AS j FROM f)""",
)
def fd_small(spark, d):
    rows = sketch.FrequentDirections(ell=2).transform(T.vectors(spark, d))
    cells = rows.select("pid", F.get("data", F.lit(0)).alias("x0"), F.posexplode("data").alias("j", "x"))
    return cells.groupBy("pid", "j").agg(r6(F.sum(F.col("x") * F.col("x"))).alias("own"), r6(F.sum(F.col("x") * F.col("x0"))).alias("with_first"))


def _ccipca_sql(n: int, key: str) -> str:
    """CTEs x and v: the unnormalised components v1 to vn of each key k after each row t."""
    dot = "list_dot_product({}, {})".format
    line = "list_transform(list_zip({a}, {b}), lambda z: {p} * z[1] + {q} * z[2])".format
    step = f"SELECT v.k, x.t, {', '.join(f'v.v{i}' for i in range(1, n + 1))}, x.u FROM v JOIN x ON x.k = v.k AND x.t = v.t + 1"
    names = lambda skip: ", ".join(f"v{i}" for i in range(1, n + 1) if i != skip)
    for i in range(1, n + 1):
        new = line(a=f"v{i}", b="u", p="((t - 3.5::DOUBLE) / t)", q=f"(3.5::DOUBLE / t * {dot('u', f'v{i}')} / sqrt({dot(f'v{i}', f'v{i}')}))")
        step = f"SELECT k, t, {names(i)}, u, CASE WHEN t >= {i} THEN {new} ELSE v{i} END AS v{i} FROM ({step})"
        rest = line(a="u", b=f"v{i}", p="1", q=f"(-{dot('u', f'v{i}')} / {dot(f'v{i}', f'v{i}')})")
        step = f"SELECT k, t, {names(0)}, CASE WHEN t >= {i} THEN {rest} ELSE u END AS u FROM ({step})"
    start = ", ".join(f"any_value(u) FILTER (t = {i}) AS v{i}" for i in range(1, n + 1))
    return f"""x AS (SELECT {key} AS k, list_transform(embedding, lambda e: e::DOUBLE) AS u, row_number() OVER (PARTITION BY {key} ORDER BY vec_id) AS t FROM embeddings),
      v AS (SELECT k, 0::BIGINT AS t, {start} FROM x GROUP BY k UNION ALL SELECT k, t, {names(0)} FROM ({step})),
      c AS (SELECT k, value, v, row_number() OVER (PARTITION BY k ORDER BY value DESC, i) - 1 AS component FROM (SELECT k, i, v, sqrt(list_dot_product(v, v)) AS value
        FROM (SELECT k, unnest(range(0, {n})) AS i, unnest([{names(0)}]) AS v FROM (SELECT * FROM v QUALIFY t = max(t) OVER (PARTITION BY k)))))"""


_COMPONENTS = "round(value, 6) AS value, j::INT AS j, round(v[j + 1] / value, 6) + 0.0::DOUBLE AS x FROM (SELECT *, unnest(range(0, len(v))) AS j FROM c)"


def _components(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "component", r6("value").alias("value"), F.posexplode("vector").alias("j", "x")).withColumn("x", r6("x"))


@query("ccipca_components", f"WITH RECURSIVE {_ccipca_sql(11, '0')} SELECT component::INT AS component, {_COMPONENTS}")
def ccipca_components(spark, d):
    return _components(pca.CCIPCA(key="all", components=11).transform(T.vectors(spark, d).withColumn("all", F.lit(0))), "all").drop("all")


@query("ccipca_batches", f"WITH RECURSIVE {_ccipca_sql(5, 'vec_id // 100')} SELECT k AS batch_id, component::INT AS component, {_COMPONENTS}")
def ccipca_batches(spark, d):
    v = T.vectors(spark, d).withColumn("batch_id", F.floor(F.col("seq") / 100))
    return _components(pca.CCIPCA(key="batch_id", components=5).transform(v), "batch_id")


_BASIS = [[0.125] * 64, [0.125] * 32 + [-0.125] * 32]
_DOTS = "v AS (SELECT vec_id AS seq, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS n, 0.125::DOUBLE * list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS p, 0.125::DOUBLE * (list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)) - list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE))) AS q FROM embeddings)"


@query("spe_q", f"WITH {_DOTS} SELECT seq, round(n - p * p - q * q, 6) + 0.0::DOUBLE AS spe FROM v")
def spe_q(spark, d):
    return T.vectors(spark, d).select("seq", r6(pca.spe(F.col("data"), _BASIS)).alias("spe"))


@query("hotelling_t2", f"WITH {_DOTS} SELECT seq, round(p * p / 2.0::DOUBLE + q * q / 0.5::DOUBLE, 6) + 0.0::DOUBLE AS t2 FROM v")
def hotelling_t2(spark, d):
    return T.vectors(spark, d).select("seq", r6(pca.hotelling(F.col("data"), _BASIS, [2.0, 0.5])).alias("t2"))


#: Sets of values whose limits are asked for: name, all of them.
_VALUES = {"flat": [1.0, 1.0, 1.0, 1.0], "falling": [3.0, 2.0, 1.0, 0.5, 0.25], "one": [2.0], "long": [0.9**k for k in range(12)]}


def _quantile_sql(name: str, degrees: str, share: float) -> str:
    """CTE name (df, x): chi-squared quantiles for the rows of degrees (df), by halving on the series of the gamma function."""
    return f"""{name}_steps AS (SELECT df, 0.0::DOUBLE AS low, 400.0::DOUBLE AS high, 0 AS n FROM ({degrees})
        UNION ALL SELECT df, CASE WHEN p < {share} THEN x ELSE low END, CASE WHEN p < {share} THEN high ELSE x END, n + 1
        FROM (SELECT *, list_sum(list_transform(range(0, 600), lambda i: exp((df / 2.0::DOUBLE + i) * ln(x / 2) - x / 2 - lgamma(df / 2.0::DOUBLE + i + 1)))) AS p FROM (SELECT *, (low + high) / 2 AS x FROM {name}_steps WHERE n < 60))),
      {name} AS (SELECT df, (low + high) / 2 AS x FROM {name}_steps WHERE n = 60)"""


# the normal quantile of 0.98 is the root of the chi-squared quantile of 0.96 with one degree
_Z = _quantile_sql("z", "SELECT 1 AS df", 0.96)
_T = "list_sum(list_transform(v, lambda e: e ^ {}))".format
_SUMS3 = f"s AS (SELECT *, {_T(1)} AS t1, {_T(2)} AS t2, {_T(3)} AS t3 FROM w), h AS (SELECT *, 1 - 2 * t1 * t3 / (3 * t2 ^ 2) AS h, (SELECT sqrt(x) FROM z) AS z FROM s)"
_CLASSIC = "t1 * (z * sqrt(2 * t2 * h * h) / t1 + 1 + t2 * h * (h - 1) / t1 ^ 2) ^ (1 / h)"


@query(
    "pca_limits",
    f"""WITH RECURSIVE {_quantile_sql("t", "SELECT unnest([1, 4, 5, 12]) AS df", 0.98)}, {_Z},
      w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', [{', '.join(f'{x!r}::DOUBLE' for x in v)}])" for k, v in _VALUES.items())}) AS q(name, v)), {_SUMS3}
      SELECT name, len(v)::INT AS df, round(t.x, 6) AS t_limit, round({_CLASSIC}, 6) AS q_classic, CASE WHEN h >= 0 THEN round((t1 * (sqrt(h * z * 2 * t2) / t1 + 1 + t2 * h * (h - 1) / t1 ^ 2)) ^ (1 / h), 6) END AS q_limit FROM h JOIN t ON t.df = len(v)""",
)
def pca_limits(spark, d):
    rows = [(k, len(v), round(pca.t_limit(v), 6), round(pca.q_limit(v, form="classic"), 6), None if (q := pca.q_limit(v)) != q else round(q, 6)) for k, v in _VALUES.items()]
    return spark.createDataFrame(rows, "name string, df int, t_limit double, q_classic double, q_limit double")


def _orthonormal_sql(n: int) -> str:
    """CTE p: the first n components of c, each less its part along those before it, of length 1, as b0 to b(n - 1)."""
    dot = "list_dot_product({}, {})".format
    out = "SELECT " + ", ".join(f"any_value(v) FILTER (component = {i}) AS b{i}" for i in range(n)) + " FROM c"
    for i in range(n):
        for k in range(i):
            out = f"SELECT * REPLACE (list_transform(list_zip(b{i}, b{k}), lambda z: z[1] - {dot(f'b{i}', f'b{k}')} * z[2]) AS b{i}) FROM ({out})"
        out = f"SELECT * REPLACE (list_transform(b{i}, lambda e: e / sqrt({dot(f'b{i}', f'b{i}')})) AS b{i}) FROM ({out})"
    return f"p AS ({out})"


@query(
    "pca_anomaly",
    f"""WITH RECURSIVE {_ccipca_sql(11, '0')}, {_orthonormal_sql(3)}, {_quantile_sql("t", "SELECT 3 AS df", 0.98)}, {_Z},
      w AS (SELECT list(value ORDER BY component) FILTER (component >= 3) AS v, list(value ORDER BY component) FILTER (component < 3) AS own FROM c), {_SUMS3},
      d AS (SELECT vec_id AS seq, list_dot_product(u, u) AS n, list_dot_product(u, b0) AS d0, list_dot_product(u, b1) AS d1, list_dot_product(u, b2) AS d2 FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS u FROM embeddings) CROSS JOIN p),
      r AS (SELECT seq, n - d0 ^ 2 - d1 ^ 2 - d2 ^ 2 AS spe, d0 ^ 2 / own[1] + d1 ^ 2 / own[2] + d2 ^ 2 / own[3] AS t2, {_CLASSIC} AS q, (SELECT x FROM t) AS t FROM d CROSS JOIN h)
      SELECT seq, round(spe, 6) + 0.0::DOUBLE AS spe, round(t2, 6) + 0.0::DOUBLE AS t2, spe > q OR t2 > t AS anomaly FROM r""",
)
def pca_anomaly(spark, d):
    v = T.vectors(spark, d)
    return rounded(pca.PCAAnomaly(components=11, kept=3).fit(v).predict(v).select("seq", "spe", "t2", "anomaly"), "spe", "t2")


# --- D. online regression ---------------------------------------------------------------------------------------

_XY = "s AS (SELECT event_type AS model_key, event_id AS idx, value / 97 AS x0, (event_id % 7 - 3) / 3.0::DOUBLE AS x1, value / 53 - (user_id % 5) / 3.7::DOUBLE AS y FROM events)"
_SUMS = "count(*) AS n, round(1 + sum(x0 * x0) + {g}, 6) AS a00, round(sum(x0 * x1), 6) + 0.0::DOUBLE AS a01, round(sum(x0 * x1), 6) + 0.0::DOUBLE AS a10, round(1 + sum(x1 * x1) + {g}, 6) AS a11, round(sum(x0 * y), 6) + 0.0::DOUBLE AS b0, round(sum(x1 * y), 6) + 0.0::DOUBLE AS b1"


def _labelled(spark, d, classes: bool = False):
    log = T.event_log(spark, d, classes=classes)
    return online.paired(log).where("kind = 'y'")


def _model(spark, d, grow=0.0):
    t = T.table(spark, d, "events")
    rows = t.select(F.col("event_type").alias("model_key"), vector(F.col("value") / 97, (F.col("event_id") % 7 - 3) / 3.0).alias("features"), (F.col("value") / 53 - (F.col("user_id") % 5) / 3.7).alias("label"))
    out = online.additive_model(rows, 2, keys=["model_key"], grow=grow)
    return rounded(out, "a00", "a01", "a10", "a11", "b0", "b1")


@query("aar_model", f"WITH {_XY} SELECT model_key, {_SUMS.format(g='0')} FROM s GROUP BY model_key")
def aar_model(spark, d):
    return _model(spark, d)


@query("orr_model", f"WITH {_XY} SELECT model_key, {_SUMS.format(g='0')} FROM s GROUP BY model_key")
def orr_model(spark, d):
    return _model(spark, d)


@query("lasso_model", f"WITH {_XY} SELECT model_key, {_SUMS.format(g='count(*) / 2.0::DOUBLE')} FROM s GROUP BY model_key")
def lasso_model(spark, d):
    return _model(spark, d, grow=0.5)


def _additive_sql(score: str, grow: str = "0.0::DOUBLE") -> str:
    """Labels reach the model before features four events later: labels of idx <= i - 4."""
    w = "OVER (PARTITION BY model_key ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)"
    return f"""WITH {_XY}, a AS (SELECT model_key, idx, x0, x1,
        1 + coalesce(sum(x0 * x0) {w}, 0) + {grow} * count(*) {w} AS p, coalesce(sum(x0 * x1) {w}, 0) AS q, 1 + coalesce(sum(x1 * x1) {w}, 0) + {grow} * count(*) {w} AS r,
        coalesce(sum(x0 * y) {w}, 0) AS b0, coalesce(sum(x1 * y) {w}, 0) AS b1 FROM s),
      v AS (SELECT *, (r * x0 - q * x1) / (p * r - q * q) AS u0, (p * x1 - q * x0) / (p * r - q * q) AS u1 FROM a)
      SELECT model_key, idx, round({score}, 6) + 0.0::DOUBLE AS prediction FROM v"""


def _predictions(spark, d, learner, classes=False, slope=0.0, **how):
    out = online.Prequential(learner=learner, features=2, **how).transform(T.event_log(spark, d, classes=classes, slope=slope))
    return out.where("kind = 'prediction'").select("model_key", "idx", r6("prediction").alias("prediction"))


@query("aar_prequential", _additive_sql("(b0 * u0 + b1 * u1) / (1 + x0 * u0 + x1 * u1)"))
def aar_prequential(spark, d):
    return _predictions(spark, d, online.Aggregating())


@query("orr_prequential", _additive_sql("b0 * u0 + b1 * u1"))
def orr_prequential(spark, d):
    return _predictions(spark, d, online.Ridge())


@query("lasso_prequential", _additive_sql("b0 * u0 + b1 * u1", "0.5::DOUBLE"))
def lasso_prequential(spark, d):
    return _predictions(spark, d, online.Lasso(gamma=4.0))


def _fold_sql(start: str, step: str, predict: str, classes: bool, slope: float = 0.0) -> str:
    """States after each label by recursion, then predictions from the state that features see."""
    y = "CASE WHEN user_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END" if classes else "value / 53 - (user_id % 5) / 3.7::DOUBLE"
    y = f"{y} + {slope}::DOUBLE * ((event_id % 7 - 3) / 3.0::DOUBLE)" if slope else y
    return f"""WITH RECURSIVE s AS (SELECT event_type AS model_key, event_id AS idx, value / 97 AS x0, (event_id % 7 - 3) / 3.0::DOUBLE AS x1, {y} AS y,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n,
        count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS seen FROM events),
      m AS (SELECT model_key, 0::BIGINT AS n, {start} FROM (SELECT DISTINCT model_key FROM s)
        UNION ALL SELECT model_key, n, {step} FROM (SELECT m.* EXCLUDE (n), s.n, s.x0, s.x1, s.y, s.idx FROM m JOIN s ON s.model_key = m.model_key AND s.n = m.n + 1))
      SELECT model_key, idx, round({predict}, 6) + 0.0::DOUBLE AS prediction FROM (SELECT s.model_key, s.idx, s.x0, s.x1, m.* EXCLUDE (model_key, n) FROM s JOIN m ON m.model_key = s.model_key AND m.n = s.seen)"""


_DOT = "(w0 * x0 + w1 * x1)"
def _shrinking_sql(cross: float = 0.0, competitive: bool = True, slope: float = 0.0) -> str:
    """Two features: D (L + D A D)^-1 D written out for L = [[0.5, cross], [cross, 0.5]], and the prediction."""

    def middle(a: tuple[str, str, str]) -> tuple[str, str, str]:
        d0, d1 = "sqrt(abs(w0))", "sqrt(abs(w1))"
        p, q, r = f"(0.5::DOUBLE + {d0} * {d0} * {a[0]})", f"({cross}::DOUBLE + {d0} * {d1} * {a[1]})", f"(0.5::DOUBLE + {d1} * {d1} * {a[2]})"
        det = f"({p} * {r} - {q} * {q})"
        return f"({d0} * {d0} * {r} / {det})", f"(-{d0} * {d1} * {q} / {det})", f"({d1} * {d1} * {p} / {det})"

    new = ("(a + x0 * x0)", "(b + x0 * x1)", "(c + x1 * x1)")
    b0, b1 = "(e + y * x0)", "(f + y * x1)"
    m, k = middle(new), middle(("a", "b", "c"))
    step = ", ".join([f"{m[0]} * {b0} + {m[1]} * {b1}", f"{m[1]} * {b0} + {m[2]} * {b1}", *new, b0, b1])
    start = "0.1::DOUBLE AS w0, 0.1::DOUBLE AS w1, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f"
    share = f" / (1 + x0 * x0 * {k[0]} + 2 * x0 * x1 * {k[1]} + x1 * x1 * {k[2]})" if competitive else ""
    return _fold_sql(start, step, f"{_DOT}{share}", False, slope)


# zero weights are absorbing, and near them rounding is amplified: labels depend on both features here
@query("oslog", _shrinking_sql(0.1, False, 0.9))
def oslog(spark, d):
    return _predictions(spark, d, online.Shrinking(penalty=[[0.5, 0.1], [0.1, 0.5]]), slope=0.9)


@query("coirr", _shrinking_sql())
def coirr(spark, d):
    return _predictions(spark, d, online.Shrinking(penalty=0.5, competitive=True))


_LMS = f"(y - {_DOT}) / (1 + x0 * x0 + x1 * x1)"


@query("tnlms", _fold_sql("0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1", f"w0 + {_LMS} * x0, w1 + {_LMS} * x1", _DOT, False))
def tnlms(spark, d):
    return _predictions(spark, d, online.NormalisedLMS())


@query("warm_start", _fold_sql("CASE WHEN model_key = 'view' THEN 0.4::DOUBLE ELSE -0.1::DOUBLE END AS w0, 0.2::DOUBLE AS w1", f"w0 + {_LMS} * x0, w1 + {_LMS} * x1", _DOT, False))
def warm_start(spark, d):
    """Learning goes on from a table of saved models."""
    keys = T.table(spark, d, "events").select(F.col("event_type").alias("model_key")).distinct()
    saved = keys.withColumn("state", F.array(F.when(F.col("model_key") == "view", 0.4).otherwise(-0.1), F.lit(0.2)))
    return _predictions(spark, d, online.NormalisedLMS(), initial=saved)


@query(
    "predict_saved",
    f"""WITH {_XY}, m AS (SELECT model_key, 1 + sum(x0 * x0) AS p, sum(x0 * x1) AS q, 1 + sum(x1 * x1) AS r, sum(x0 * y) AS b0, sum(x1 * y) AS b1 FROM s GROUP BY model_key)
      SELECT model_key, idx, round((b0 * (r * x0 - q * x1) + b1 * (p * x1 - q * x0)) / (p * r - q * q), 6) + 0.0::DOUBLE AS prediction FROM s JOIN m USING (model_key)""",
)
def predict_saved(spark, d):
    """All events are predicted by the models that a run has left."""
    learner, log = online.Ridge(), T.event_log(spark, d)
    models = online.Prequential(learner=learner, features=2).transform(log).where("kind = 'model'")
    rows = log.where("kind = 'x'").select("model_key", "idx", "features")
    return online.predict(learner, staged(models, "models"), rows, 2).select("model_key", "idx", r6("prediction").alias("prediction"))


@query(
    "lasso_impute",
    """SELECT event_id AS seq, coalesce(last_value(CASE WHEN event_id % 3 = 1 THEN value END IGNORE NULLS) OVER w, 5.0::DOUBLE) AS f1,
    coalesce(last_value(CASE WHEN event_id % 5 = 2 THEN value END IGNORE NULLS) OVER w, 0.0::DOUBLE) AS f2 FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def lasso_impute(spark, d):
    nan = F.lit(float("nan"))
    t = T.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 1, F.col("value")).otherwise(nan).alias("f1"), F.when(F.col("event_id") % 5 == 2, F.col("value")).otherwise(nan).alias("f2"))
    return lasso.impute(t, ["f1", "f2"], default={"f1": 5.0})


def _sensors(spark, d):
    t = T.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") / 40).cast("bigint").alias("coil_id"), (F.col("event_id") % 40).cast("double").alias("x"), "value", "user_id")
    nan = F.lit(float("nan"))
    rows = t.select("coil_id", "seq", "x", F.when(F.col("seq") % 4 == 0, nan).otherwise(F.col("value") / 100).alias("f1"), ((F.col("seq") % 9) / 9.0).alias("f2"))
    # a coil's labels come when the next coil is half through
    ends = T.table(spark, d, "events").where("value > 90").select((F.col("event_id") / 40).cast("bigint").alias("coil_id"), (F.col("event_id") % 40).cast("double").alias("x"), (F.col("user_id") / 10.0).alias("v"))
    ends = ends.groupBy("coil_id").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("l"))  # 40 at most
    bundles = ends.select("coil_id", (F.col("coil_id") * 40 + 60).alias("seq"), F.transform("l", lambda z: z["x"]).alias("poses"), F.transform("l", lambda z: z["v"]).alias("labels"))
    return rows, bundles


_NEAREST = """k AS (SELECT r.coil_id, row_id, x, p, v, row_number() OVER (PARTITION BY row_id ORDER BY abs(x - p), label_no) AS k FROM r LEFT JOIN l ON l.coil_id = r.coil_id),
    t AS (SELECT coil_id, row_id, x, max(p) FILTER (k = 1) AS p1, max(v) FILTER (k = 1) AS v1, max(p) FILTER (k = 2) AS p2, max(v) FILTER (k = 2) AS v2 FROM k GROUP BY coil_id, row_id, x)"""
_LINE = "CASE WHEN p2 IS NULL OR p1 = p2 THEN v1 ELSE v1 + (x - p1) * (v2 - v1) / (p2 - p1) END"
_DEFAULTS = {f"f{k}": v for k, v in T.SENSOR_DEFAULTS.items()}


@query(
    "lasso_delayed",
    f"""WITH l AS (SELECT event_id // 40 AS coil_id, event_id AS label_no, (event_id % 40)::DOUBLE AS p, user_id / 10.0::DOUBLE AS v FROM events WHERE value > 90),
    r AS (SELECT event_id // 40 AS coil_id, event_id AS row_id, (event_id % 40)::DOUBLE AS x,
      coalesce(last_value(CASE WHEN event_id % 4 > 0 THEN value / 100 END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {_DEFAULTS["f1"]}::DOUBLE) AS x0, (event_id % 9) / 9.0::DOUBLE AS x1 FROM events),
    {_NEAREST},
    y AS (SELECT t.coil_id * 40 + 60 AS due, x0, x1, {_LINE} AS y FROM t JOIN (SELECT row_id, x0, x1 FROM r) USING (row_id) WHERE v1 IS NOT NULL),
    b AS (SELECT due, count(*) AS n, sum(x0 * x0) AS p, sum(x0 * x1) AS q, sum(x1 * x1) AS r, sum(x0 * y) AS b0, sum(x1 * y) AS b1 FROM y GROUP BY due),
    c AS (SELECT due, 1 + sum(p + n) OVER w AS p, sum(q) OVER w AS q, 1 + sum(r + n) OVER w AS r, sum(b0) OVER w AS b0, sum(b1) OVER w AS b1 FROM b WINDOW w AS (ORDER BY due)),
    m AS (SELECT r.row_id, r.x0, r.x1, c.* FROM r ASOF LEFT JOIN c ON r.row_id > c.due)
    SELECT row_id AS idx, round(coalesce((b0 * (r * x0 - q * x1) + b1 * (p * x1 - q * x0)) / (p * r - q * q), 0), 6) + 0.0::DOUBLE AS prediction FROM m""",
)
def lasso_delayed(spark, d):
    rows, bundles = _sensors(spark, d)
    out = lasso.LassoDelayed(features=("f1", "f2"), bundles=bundles, default=_DEFAULTS).transform(rows)
    return out.where("kind = 'prediction'").select("idx", r6("prediction").alias("prediction"))


@query(
    "flatness_map",
    f"""WITH l AS (SELECT user_id % 16 AS coil_id, event_id AS label_no, event_id / 10.0::DOUBLE AS p, value AS v FROM events WHERE event_type = 'view'),
    r AS (SELECT user_id % 16 AS coil_id, event_id AS row_id, event_id / 10.0::DOUBLE AS x FROM events WHERE event_type <> 'view'),
    {_NEAREST}
    SELECT coil_id, row_id, x, round({_LINE}, 6) + 0.0::DOUBLE AS flatness FROM t""",
)
def flatness_map(spark, d):
    t = T.table(spark, d, "events").withColumn("coil_id", F.col("user_id") % 16)
    labels = t.where("event_type = 'view'").select("coil_id", F.col("event_id").alias("label_no"), (F.col("event_id") / F.lit(10.0)).alias("x"), "value")
    rows = t.where("event_type <> 'view'").select("coil_id", F.col("event_id").alias("row_id"), (F.col("event_id") / F.lit(10.0)).alias("x"))
    return rounded(lasso.flatness_map(rows, labels), "flatness")


@query("lasso_constant", "SELECT event_id AS seq, 0.0::DOUBLE AS prediction FROM events")
def lasso_constant(spark, d):
    return lasso.LassoConstant().predict(T.table(spark, d, "events").select(F.col("event_id").alias("seq")))


# --- E. online classification -----------------------------------------------------------------------------------

_NORM = "sqrt(x0 * x0 + x1 * x1)"
_SIGN = f"sign({_DOT})"


def _pa_sql(rate: str, rho: str = "1.0", loss: str = "w0 + w1", start: str = "0.5") -> str:
    # x1 is never 0 together with x0, as values are positive
    hinge = f"greatest(0.0::DOUBLE, {loss} - y * {_DOT})"
    step = f"{rho}::DOUBLE * {rate.format(l=hinge, n=_NORM)} * y"
    return _fold_sql(f"{start}::DOUBLE AS w0, {start}::DOUBLE AS w1", f"w0 + {step} * x0, w1 + {step} * x1", _SIGN, True)


_RATES = {"plain": "({l} / {n})", "I": "least({l} / {n}, 0.5::DOUBLE)", "II": "({l} / ({n} + 1.0::DOUBLE))"}


def _register_margin() -> None:
    for suffix, variant in (("", "plain"), ("1", "I"), ("2", "II")):
        for name, rho in (("pa", 1.0), ("wapa", 0.1)):
            learner = online.PassiveAggressive(variant=variant, rho=rho)
            query(f"{name}{suffix}", _pa_sql(_RATES[variant], str(rho)))(lambda spark, d, x=learner: _predictions(spark, d, x, True))
        hinge = online.PassiveAggressive(variant=variant, loss="hinge")
        query(f"pa{suffix}_hinge", _pa_sql(_RATES[variant], loss="1.0::DOUBLE", start="0.0"))(lambda spark, d, x=hinge: _predictions(spark, d, x, True))
    for name, margin, bias in (("osvm", "reference", "b * (x0 + x1)"), ("osvm_affine", "affine", "b")):
        s = f"(CASE WHEN y * ({_DOT} + {bias}) < 1 THEN 1 ELSE 0 END)"
        step = ", ".join(f"w{i} - (w{i} - 0.5::DOUBLE * y * {s} * x{i}) / (idx + 1)" for i in (0, 1)) + f", b + y * {s} / (idx + 1)"
        sql = _fold_sql("0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b", step, f"sign({_DOT} + {bias})", True)
        query(name, sql)(lambda spark, d, m=margin: _predictions(spark, d, online.OnlineSVM(margin=m), True))
    hit = f"y * ({_DOT} + b * (x0 + x1)) < 1"
    keep = lambda new, old: f"CASE WHEN {hit} THEN {new} ELSE {old} END"
    step = ", ".join(
        [keep(f"w{i} - (w{i} - c * y * x{i}) / (idx + 1)", f"w{i}") for i in (0, 1)]
        + [keep("b + y / (idx + 1)", "b"), keep("c - yp * (coalesce(p0, x0) * x0 + coalesce(p1, x1) * x1) * y / (idx + 1)", "c"), keep("x0", "p0"), keep("x1", "p1"), keep("y", "yp")]
    )
    start = "0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b, 0.5::DOUBLE AS c, NULL::DOUBLE AS p0, NULL::DOUBLE AS p1, 1.0::DOUBLE AS yp"
    query("obsg_svm", _fold_sql(start, step, f"sign({_DOT} + b * (x0 + x1))", True))(lambda spark, d: _predictions(spark, d, online.AdaptiveSVM(), True))


_register_margin()


@query("margin_predict", "SELECT event_id AS idx, sign(0.75::DOUBLE * value / 100 - 0.5::DOUBLE * ((event_id % 7 - 3) / 3.0::DOUBLE) - 0.25::DOUBLE)::DOUBLE AS prediction FROM events")
def margin_predict(spark, d):
    x = vector(F.col("value") / 100, (F.col("event_id") % 7 - 3) / 3.0)
    rows = T.table(spark, d, "events").select(F.lit("one").alias("model_key"), F.col("event_id").alias("idx"), x.alias("features"))
    saved = spark.createDataFrame([("one", [0.75, -0.5, -0.25])], "model_key string, state array<double>")
    return online.predict(online.OnlineSVM(margin="affine"), saved, rows, 2).select("idx", "prediction")


# --- F. series, words, topics -----------------------------------------------------------------------------------


@query("sax_fit", "SELECT round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std FROM events")
def sax_fit(spark, d):
    return rounded(sax.fit_stats(T.event_series(spark, d)), "avg", "std")


_CUTS = ", ".join(f"{c}::DOUBLE" for c in sax.cuts(4))
_SAX = f"""z AS (SELECT (user_id % 8)::INT AS key, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS z, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS rn FROM events),
  f AS (SELECT key, rn // 3 AS i, avg(z) AS paa FROM z GROUP BY key, rn // 3 HAVING count(*) = 3),
  t AS (SELECT key, i, paa, chr((97 + len(list_filter([{_CUTS}], lambda c: c <= paa)))::INT) AS letter FROM f),
  w AS (SELECT key, i // 2 AS word_no, string_agg(letter, '' ORDER BY i) AS word FROM t GROUP BY key, i // 2 HAVING count(*) = 2)"""


def _sax(spark, d):
    series = T.event_series(spark, d)
    return sax.SAX(word=2, alphabet=4, paa=3).fit(series), series


@query("sax_letters", f"WITH {_SAX} SELECT key, i, round(paa, 6) + 0.0::DOUBLE AS paa, letter FROM t")
def sax_letters(spark, d):
    s, series = _sax(spark, d)
    return s.fragments(series).select("key", "i", r6("paa").alias("paa"), sax.letter(F.col("paa"), 4).alias("letter"))


@query("sax_words", f"WITH {_SAX} SELECT key, word_no, word FROM w")
def sax_words(spark, d):
    s, series = _sax(spark, d)
    return s.transform(series)


_BAGS = "n AS (SELECT class, word, count(*) AS freq FROM b GROUP BY class, word), t AS (SELECT class, n.word, freq, ln(1 + freq) * (1 + ln((SELECT count(DISTINCT class) FROM n) // df)) AS tfidf FROM n JOIN (SELECT word, count(DISTINCT class) AS df FROM n GROUP BY word) USING (word))"
_DOC_WORDS = "b AS (SELECT lang AS class, unnest(string_split(text, ' ')) AS word FROM documents)"


def _document_words(spark, d):
    return T.table(spark, d, "documents").select(F.col("lang").alias("class"), F.explode(F.split("text", " ", -1)).alias("word"))


@query("dict_tfidf", f"WITH {_DOC_WORDS}, {_BAGS} SELECT class, word, freq, round(tfidf, 6) + 0.0::DOUBLE AS tfidf FROM t")
def dict_tfidf(spark, d):
    return rounded(sax.SAXDictionary().fit(_document_words(spark, d)).table, "tfidf")


@query("dict_sizes", f"WITH {_DOC_WORDS}, {_BAGS} SELECT class, count(*) AS words FROM t GROUP BY class")
def dict_sizes(spark, d):
    return sax.SAXDictionary().fit(_document_words(spark, d)).max_words_by_class()


@query("dict_saved", f"WITH {_DOC_WORDS}, {_BAGS} SELECT class, word, freq, round(tfidf, 6) + 0.0::DOUBLE AS tfidf FROM t")
def dict_saved(spark, d):
    path = scratch(spark, "dictionary")
    sax.SAXDictionary().fit(_document_words(spark, d)).save(path)
    return rounded(sax.SAXDictionary().load(spark, path).table, "tfidf")


def _predict_sql(words: str, n: int) -> str:
    """words: CTEs b (class, word) and q (key, word_no, word)."""
    return f"""WITH {words}, {_BAGS}, r AS (SELECT key, word, (row_number() OVER (PARTITION BY key ORDER BY word_no) - 1) // {n} AS window_no FROM q),
      c AS (SELECT key, window_no, word, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT key, window_no, sqrt(sum(c * c)) AS norm FROM c GROUP BY ALL HAVING sum(c) = {n}),
      k AS (SELECT class, sqrt(sum(tfidf * tfidf)) AS norm FROM t GROUP BY class),
      d AS (SELECT m.key, m.window_no, k.class, coalesce(sum(c.c * t.tfidf), 0) / (m.norm * k.norm) AS s FROM m CROSS JOIN k JOIN c ON c.key = m.key AND c.window_no = m.window_no LEFT JOIN t ON t.class = k.class AND t.word = c.word GROUP BY m.key, m.window_no, k.class, m.norm, k.norm),
      o AS (SELECT *, row_number() OVER (PARTITION BY key, window_no ORDER BY round(s, 12) DESC, class) AS o FROM d)
      SELECT key, window_no, class, round(s, 6) + 0.0::DOUBLE AS similarity FROM o WHERE o = 1"""


_EVENT_WORDS = "b AS (SELECT (user_id % 4)::VARCHAR AS class, event_type || (event_id % 7) AS word FROM events), q AS (SELECT (user_id % 8)::INT AS key, event_id AS word_no, event_type || (event_id % 9) AS word FROM events)"


@query("dict_predict", _predict_sql(_EVENT_WORDS, 5))
def dict_predict(spark, d):
    t = T.table(spark, d, "events")
    words = t.select((F.col("user_id") % 4).cast("string").alias("class"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("word"))
    asked = t.select((F.col("user_id") % 8).cast("int").alias("key"), F.col("event_id").alias("word_no"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("word"))
    return rounded(sax.SAXDictionary(words=5).fit(words).predict(asked), "similarity")


@query("sax_vsm_pipeline", _predict_sql(f"{_SAX.replace(' t AS', ' a AS').replace('FROM t ', 'FROM a ')}, b AS (SELECT 'c' || (key % 3) AS class, word FROM w), q AS (SELECT key, word_no, word FROM w)", 4))
def sax_vsm_pipeline(spark, d):
    s, series = _sax(spark, d)
    words = s.transform(series).withColumn("class", F.concat(F.lit("c"), (F.col("key") % 3).cast("string")))
    return rounded(s.then(sax.SAXDictionary(words=4).fit(words)).predict(series), "similarity")


@query("lda_tokens", "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY doc_id, word")
def lda_tokens(spark, d):
    t = T.table(spark, d, "documents")
    return topics.token_counts(t.select("doc_id", F.split("text", " ", -1).alias("tokens")))


_LDA_WORDS = """w AS (SELECT unnest(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: trim(x, '.,;:!?"''()')), lambda x: x <> '')) AS word FROM documents),
  n AS (SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 10000)"""


def _topics(spark, d):
    return topics.OnlineLDA().fit(topics.tokenised(T.table(spark, d, "documents")))


@query("lda_topics", f"WITH {_LDA_WORDS} SELECT word, 20::BIGINT AS topics, true AS shares FROM n")
def lda_topics(spark, d):
    """The words of the model, with how many topics give each a share, all in (0, 1)."""
    found = _topics(spark, d).topics(spark)
    return found.groupBy("word").agg(F.count_distinct("topic").alias("topics"), F.min((F.col("weight") > 0) & (F.col("weight") < 1)).alias("shares"))


@query("lda_sums", f"WITH {_LDA_WORDS} SELECT unnest(range(0, 20))::INT AS topic, (SELECT count(*) FROM n) AS words, 1.0::DOUBLE AS share")
def lda_sums(spark, d):
    found = _topics(spark, d).topics(spark)
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("words"), r6(F.sum("weight")).alias("share"))


# --- G. evaluation ----------------------------------------------------------------------------------------------

_CELLS = "s AS (SELECT event_type AS pid, event_id AS seq, value - 40 AS p, CASE WHEN user_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM events), c AS (SELECT *, (p > 0 AND y > 0)::INT AS tp_, (p > 0 AND y < 0)::INT AS fp_, (p <= 0 AND y < 0)::INT AS tn_, (p <= 0 AND y > 0)::INT AS fn_ FROM s)"
_METRICS = """tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END, 6) AS fpr, round(CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END ELSE 0 END, 6) AS f"""
_NAMES = ("accuracy", "precision", "recall", "fpr", "f")


def _judged(spark, d):
    t = T.table(spark, d, "events")
    return t.select(F.col("event_type").alias("pid"), F.col("event_id").alias("seq"), (F.col("value") - 40).alias("prediction"), F.when(F.col("user_id") % 3 == 0, -1.0).otherwise(1.0).alias("label"))


@query("confusion_final", f"WITH {_CELLS}, m AS (SELECT pid, sum(tp_)::BIGINT AS tp, sum(fp_)::BIGINT AS fp, sum(tn_)::BIGINT AS tn, sum(fn_)::BIGINT AS fn FROM c GROUP BY pid) SELECT pid, {_METRICS} FROM m")
def confusion_final(spark, d):
    return rounded(evaluation.confusion(_judged(spark, d), keys=["pid"]), *_NAMES)


@query("confusion_running", f"WITH {_CELLS}, m AS (SELECT pid, seq, (sum(tp_) OVER w)::BIGINT AS tp, (sum(fp_) OVER w)::BIGINT AS fp, (sum(tn_) OVER w)::BIGINT AS tn, (sum(fn_) OVER w)::BIGINT AS fn FROM c WINDOW w AS (PARTITION BY pid ORDER BY seq)) SELECT pid, seq, {_METRICS} FROM m")
def confusion_running(spark, d):
    return rounded(evaluation.running_confusion(_judged(spark, d), ["pid"], ["seq"]), *_NAMES).drop("prediction", "label")


@query("label_join", "SELECT event_id AS idx, value - 40 AS prediction, CASE WHEN user_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS label FROM events")
def label_join(spark, d):
    j = _judged(spark, d).withColumnRenamed("seq", "idx")
    return evaluation.match(j.select("idx", "prediction"), j.select("idx", "label"), ["idx"])
