"""Online latent Dirichlet allocation by stochastic variational inference, distributed over documents.

A mini-batch's expectation step runs on the executors: each task infers the topics of its documents with the current
topic-word table (broadcast; its size is topics x vocabulary, fixed by parameters) and sums their statistics, and
only those sums meet. The driver blends them into the table with a decaying step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Predictor
from ..schemas import require


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, "f8", copy=True)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out -= small / x
        x += small
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def dirichlet_expectation(a: np.ndarray) -> np.ndarray:
    """E[log theta] of Dirichlets in the rows of a."""
    return digamma(a) - digamma(a.sum(axis=-1, keepdims=True))


def vocabulary(docs: DataFrame, size: int) -> list[str]:
    """The most frequent words, ties in order of the word; at most `size`, a parameter."""
    words = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in words.orderBy(F.desc("n"), "word").limit(size).collect()]


def tokenised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and tokens: lower-cased words split at white space, punctuation at their ends removed."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    clean = F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(".,;:!?\"'()"))), lambda w: w != "")
    return docs.select(F.col(doc_id).alias("doc_id"), clean.alias("tokens"))


#: Ids of documents of several rows that are broadcast to find those rows; beyond it all counts meet by an exchange.
MAX_AGAIN = 1_000_000


def _counted(rows: DataFrame) -> DataFrame:
    """doc_id, word, n of each row's own tokens: runs in the sorted tokens, no exchange."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        of = lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("n")))
        return F.flatten(F.transform(F.array(begins), of))

    # arrays of one are variables: what they hold is not reckoned for each word again
    found = F.flatten(F.transform(F.array(F.sort_array("tokens")), runs))
    return rows.where(F.size("tokens") > 0).select(*[c for c in rows.columns if c != "tokens"], F.inline(found))


def token_counts(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, word, n of words in the vocabulary (all, if none is given).

    Each row counts its own words. Only documents of several rows (by their ids, which alone are dealt out) need more:
    their counts are added.
    """
    docs = docs.select("doc_id", "tokens")
    if docs.isStreaming:
        rows = docs.select("doc_id", F.explode("tokens").alias("word"))
        return _known(rows, words).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    total = lambda counts: counts.groupBy("doc_id", "word").agg(F.sum("n").alias("n"))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("__id"), F.lit(True).alias("__again"))
    many = again.limit(MAX_AGAIN + 1).count()
    if not many:
        return _known(_counted(docs), words).select("doc_id", "word", "n")
    if many > MAX_AGAIN:
        return total(_known(_counted(docs), words))
    marked = docs.join(F.broadcast(again), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    counts = _known(_counted(marked), words).select("doc_id", "word", "n", "__again")
    return counts.where("__again is null").drop("__again").unionByName(total(counts.where("__again")))


def _known(rows: DataFrame, words: list[str] | None) -> DataFrame:
    if words is None:
        return rows
    known = rows.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return rows.join(F.broadcast(known), "word")  # size is a parameter


def infer(ids: np.ndarray, counts: np.ndarray, exp_beta: np.ndarray, alpha: float, rounds: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """gamma of one document and its statistics (topics x its words), before the factor exp_beta."""
    k = exp_beta.shape[0]
    gamma = np.ones(k)
    beta = exp_beta[:, ids]
    for _ in range(rounds):
        theta = np.exp(dirichlet_expectation(gamma))
        new = alpha + theta * (beta @ (counts / (theta @ beta + 1e-100)))
        done = np.abs(new - gamma).mean() < tolerance
        gamma = new
        if done:
            break
    theta = np.exp(dirichlet_expectation(gamma))
    return gamma, np.outer(theta, counts / (theta @ beta + 1e-100))


#: Documents inferred at once, and numbers of their topics x words.
BLOCK_DOCS, BLOCK_NUMBERS = 256, 1 << 20


def infer_many(docs: list[tuple[np.ndarray, np.ndarray]], exp_beta: np.ndarray, alpha: float, rounds: int = 100, tolerance: float = 1e-3) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """infer() of many documents (ids, counts), those of like length in step: numbers of documents, their ids (padded
    with 0), gamma, and statistics (documents x topics x ids; 0 where padded). Each stops by its own tolerance."""
    k = exp_beta.shape[0]
    order = sorted(range(len(docs)), key=lambda i: len(docs[i][0]))
    while order:
        longest = len(docs[order[-1]][0])
        block = order[-max(1, min(BLOCK_DOCS, BLOCK_NUMBERS // max(1, k * longest))) :]
        block = [i for i in block if 2 * len(docs[i][0]) >= longest]
        del order[-len(block) :]
        ids, counts = np.zeros((len(block), longest), "i8"), np.zeros((len(block), longest))
        for row, i in enumerate(block):
            ids[row, : len(docs[i][0])], counts[row, : len(docs[i][1])] = docs[i]
        beta = np.ascontiguousarray(exp_beta[:, ids].transpose(1, 0, 2))
        gamma, at, b, c = np.ones((len(block), k)), np.arange(len(block)), beta, counts
        for _ in range(rounds):
            theta = np.exp(dirichlet_expectation(gamma[at]))
            ratio = c / ((theta[:, None, :] @ b)[:, 0] + 1e-100)
            new = alpha + theta * (b @ ratio[:, :, None])[:, :, 0]
            going = np.abs(new - gamma[at]).mean(axis=1) >= tolerance
            gamma[at] = new
            if not going.all():
                if not going.any():
                    break
                at, b, c = at[going], b[going], c[going]
        theta = np.exp(dirichlet_expectation(gamma))
        ratio = counts / ((theta[:, None, :] @ beta)[:, 0] + 1e-100)
        yield block, ids, gamma, theta[:, :, None] * ratio[:, None, :]


def coded(batch: Any, words: Any) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The documents of an Arrow array of token lists, BLOCK_DOCS at a time, as (ids, counts) of known words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for k in range(0, len(batch), BLOCK_DOCS):
        lists = batch.slice(k, BLOCK_DOCS)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), "i8")
        ids = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=words), pa.scalar(-1, pa.int32())), "i8")
        ends = np.cumsum(sizes)
        yield [np.unique(own[own >= 0], return_counts=True) for own in (ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist()))]


class OnlineLDA(Predictor):
    """fit() makes passes of mini-batches (documents by a hash) over doc_id, tokens; partial_fit() takes one
    mini-batch, as foreachBatch of a stream does; predict() adds each document's topic shares."""

    defaults: dict[str, Any] = {"topics": 20, "words": 10_000, "alpha": None, "eta": None, "offset": 64.0, "decay": 0.7, "batches": 4, "passes": 1, "seed": 0}
    vocabulary: list[str] | None = None
    table: np.ndarray | None = None
    steps = 0

    def _start(self, docs: DataFrame) -> OnlineLDA:
        out = self.with_params()
        out.vocabulary = vocabulary(docs, self.params["words"])
        rnd = np.random.default_rng(self.params["seed"])
        out.table = rnd.gamma(100.0, 0.01, (self.params["topics"], max(1, len(out.vocabulary))))
        out.total = docs.count()
        return out

    def fit(self, docs: DataFrame, **params: Any) -> OnlineLDA:
        require(docs, "doc_id", "tokens", operator="OnlineLDA")
        out = self.with_params(**params)._start(docs)
        n = out.params["batches"]
        for _ in range(out.params["passes"]):
            for k in range(n):
                out = out.partial_fit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k))
        return out

    def partial_fit(self, docs: DataFrame) -> OnlineLDA:
        if self.table is None:
            return self._start(docs).partial_fit(docs)
        p = self.params
        k = p["topics"]
        alpha, eta = p["alpha"] or 1.0 / k, p["eta"] or 1.0 / k
        shared = docs.sparkSession.sparkContext.broadcast((self.vocabulary, np.exp(dirichlet_expectation(self.table))))

        def expect(batches):
            import pyarrow as pa

            words, exp_beta = shared.value
            words, sums, n = pa.array(words, pa.string()), np.zeros_like(exp_beta), 0
            for batch in batches:
                n += batch.num_rows
                for docs in coded(batch.column(0), words):
                    for _, ids, _, stats in infer_many([d for d in docs if len(d[0])], exp_beta, alpha):
                        for topic, own in enumerate(stats.transpose(1, 0, 2)):
                            sums[topic] += np.bincount(ids.ravel(), own.ravel(), len(words))
            used = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([[float(n)], *sums[:, used].T.tolist()], pa.list_(pa.float64()))], ["word", "sums"])

        rows = docs.select("tokens").mapInArrow(expect, "word int, sums array<double>").select("word", F.posexplode("sums").alias("topic", "x"))
        got = rows.groupBy("word", "topic").agg(F.sum("x").alias("x")).toPandas()  # vocabulary x topics
        n = float(got.loc[got.word < 0, "x"].sum())
        if not n:
            return self
        stats = np.zeros_like(self.table)
        real = got[got.word >= 0]
        stats[real.topic.to_numpy(), real.word.to_numpy()] = real.x.to_numpy()
        rho = (p["offset"] + self.steps) ** -p["decay"]
        out = self.with_params()
        out.table = (1 - rho) * self.table + rho * (eta + max(self.total, n) / n * stats * shared.value[1])
        out.steps = self.steps + 1
        return out

    def topics(self, spark) -> DataFrame:
        """topic, word, weight (share of the topic)."""
        share = self.table / self.table.sum(axis=1, keepdims=True)
        rows = [(k, w, float(share[k, i])) for k in range(len(share)) for i, w in enumerate(self.vocabulary)]
        return spark.createDataFrame(rows, "topic int, word string, weight double")

    def _predict(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        if self.table is None:
            raise RuntimeError("OnlineLDA is not fitted")
        alpha = p["alpha"] or 1.0 / p["topics"]
        shared = df.sparkSession.sparkContext.broadcast((self.vocabulary, np.exp(dirichlet_expectation(self.table))))

        def run(batches):
            import pyarrow as pa

            words, exp_beta = shared.value
            words = pa.array(words, pa.string())
            for batch in batches:
                out = np.full((batch.num_rows, len(exp_beta)), alpha)
                for k, docs in enumerate(coded(batch.column(1), words)):
                    known = [i for i, d in enumerate(docs) if len(d[0])]
                    for block, _, gamma, _ in infer_many([docs[i] for i in known], exp_beta, alpha):
                        out[[k * BLOCK_DOCS + known[i] for i in block]] = gamma
                out = (out / out.sum(axis=1, keepdims=True)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "topics"])

        return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "tokens").mapInArrow(run, "doc_id bigint, topics array<double>")


__all__ = ["OnlineLDA", "digamma", "dirichlet_expectation", "infer", "infer_many", "log_sum_exp", "token_counts", "tokenised", "vocabulary"]
