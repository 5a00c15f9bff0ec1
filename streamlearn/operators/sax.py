"""Symbolic aggregate approximation of keyed series, and the bag-of-words dictionary that classifies its words."""

from __future__ import annotations

from statistics import NormalDist
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import Operator, Predictor
from ..plans.fold import Fold
from ..plans.running import numbered
from ..plans.shared import staged
from ..schemas import require
from ..streaming.state import stream_fold

#: More dictionary rows than this are joined by an exchange and not by a broadcast.
MAX_BROADCAST_WORDS = 1_000_000


def cuts(alphabet: int) -> list[float]:
    """Breakpoints that divide a standard normal into equally likely letters, to seven decimals as tabulated."""
    if not 2 <= alphabet <= 10:
        raise ValueError("alphabets have 2 to 10 letters")
    return [round(NormalDist().inv_cdf(k / alphabet), 7) + 0.0 for k in range(1, alphabet)]


def distance_matrix(alphabet: int) -> list[list[float]]:
    if alphabet != 2:
        raise ValueError("only the matrix of two letters is defined")
    return [[0.0, 0.0], [0.0, 0.0]]


def letter(x: Column, alphabet: int) -> Column:
    """The letter whose number is that of the cuts not above x."""
    n = F.lit(0)
    for c in cuts(alphabet):
        n = n + (x >= F.lit(c)).cast("int")
    return F.char((n + 97).cast("bigint"))


class SAX(Operator):
    """fit(): mean and population deviation of all values. transform(): per key, values are normalised, tumbling
    count windows of `paa` values are averaged, and `word` averages make a word of letters; what is incomplete at
    the end is dropped."""

    defaults: dict[str, Any] = {"key": "key", "order": "seq", "value": "value", "word": 1, "alphabet": 2, "paa": 2}
    fitted: tuple[float, float] | None = None

    def fit(self, df: DataFrame, **params: Any) -> SAX:
        p = self._merged(self.params, params)
        r = fit_stats(df, p["value"]).first()
        return self.with_params(**params).load(r["avg"], r["std"])

    def load(self, avg: float, std: float) -> SAX:
        out = self.with_params()
        out.fitted = (avg, std)
        return out

    def normalised(self, value: Column) -> Column:
        if self.fitted is None:
            raise RuntimeError("SAX is not fitted: call fit() or load() first")
        avg, std = self.fitted
        return (value - F.lit(avg)) / F.lit(std)

    def fragments(self, df: DataFrame) -> DataFrame:
        """key, i (number of the fragment from 0) and paa, the mean of its normalised values."""
        p = self.params
        require(df, p["key"], p["order"], p["value"], operator="SAX")
        rows = numbered(df.select(p["key"], p["order"], self.normalised(F.col(p["value"])).alias("z")), [p["key"]], [p["order"]])
        block = F.floor((F.col("rn") - 1) / p["paa"]).alias("i")
        return rows.groupBy(p["key"], block).agg(F.avg("z").alias("paa"), F.count(F.lit(1)).alias("n")).where(F.col("n") == p["paa"]).drop("n")

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        if params:
            return self.with_params(**params).transform(df)
        p = self.params
        if df.isStreaming:
            self.normalised(F.lit(0.0))
            return stream_fold(df.select(p["key"], F.col(p["order"]).alias("seq"), F.col(p["value"]).alias("value")), [p["key"]], ["seq"], _Words(p, *self.fitted))
        parts = self.fragments(df)
        word_no = F.floor(F.col("i") / p["word"]).alias("word_no")
        letters = F.array_sort(F.collect_list(F.struct("i", letter(F.col("paa"), p["alphabet"]).alias("l"))))  # `word` of them at most
        words = parts.groupBy(p["key"], word_no).agg(letters.alias("ls")).where(F.size("ls") == p["word"])
        return words.select(p["key"], "word_no", F.array_join(F.transform("ls", lambda x: x["l"]), "").alias("word"))


class _Words(Fold):
    schema = "word_no bigint, word string"

    def __init__(self, p: dict[str, Any], avg: float, std: float):
        self.paa, self.word, self.cuts, self.avg, self.std = p["paa"], p["word"], cuts(p["alphabet"]), avg, std

    def start(self):
        return [], [], 0

    def block(self, state, rows: pd.DataFrame):
        values, letters, done = state
        out = []
        for v in rows["value"].tolist():
            values.append((v - self.avg) / self.std)
            if len(values) == self.paa:
                x = sum(values) / self.paa
                letters.append(chr(97 + sum(c <= x for c in self.cuts)))
                values = []
            if len(letters) == self.word:
                out.append((done, "".join(letters)))
                letters, done = [], done + 1
        return (values, letters, done), pd.DataFrame(out, columns=["word_no", "word"])


def fit_stats(df: DataFrame, value: str = "value") -> DataFrame:
    """avg and population std of a column, one row."""
    return df.agg(F.avg(value).alias("avg"), F.stddev_pop(value).alias("std"))


class SAXDictionary(Predictor):
    """Bags of words per class with TF-IDF weights, kept as a table (class, word, freq, tfidf).

    tfidf = log(1 + freq) * (1 + log(floor(classes / classes with the word))). fit() on more rows adds classes and
    replaces those it sees again. predict() classifies tumbling windows of `words` words per key by the cosine of
    their counts with the classes' weights; ties go to the class that sorts first.
    """

    defaults: dict[str, Any] = {"key": "key", "order": "word_no", "words": 1}
    table: DataFrame | None = None

    def fit(self, df: DataFrame, **params: Any) -> SAXDictionary:
        require(df, "class", "word", operator="SAXDictionary")
        counts = df.select(F.col("class").cast("string").alias("class"), "word").groupBy("class", "word").agg(F.count(F.lit(1)).alias("freq"))
        if self.table is not None:
            old = self.table.select("class", "word", "freq")
            counts = counts.unionByName(old.join(counts.select("class").distinct(), "class", "left_anti"))
        # a model is a table of its own: predictions do not count the words again
        return self.with_table(staged(weighted(staged(counts, "bags")), "dictionary"), **params)

    def with_table(self, table: DataFrame, **params: Any) -> SAXDictionary:
        out = self.with_params(**params)
        out.table = table
        return out

    def _bags(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError("SAXDictionary is not fitted: call fit() or load() first")
        return self.table

    def max_words_by_class(self) -> DataFrame:
        return self._bags().groupBy("class").agg(F.count(F.lit(1)).alias("words"))

    def max_words(self) -> int:
        """Distinct words of all classes."""
        return self._bags().agg(F.count_distinct("word")).first()[0]

    def recommended_words(self) -> int:
        """A window as large as the smallest class's bag."""
        return self.max_words_by_class().agg(F.min("words")).first()[0]

    def _predict(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        require(df, p["key"], p["order"], "word", operator="SAXDictionary")
        if df.isStreaming:
            rows = df.select(p["key"], F.col(p["order"]).alias("word_no"), "word")
            return classify_windows(stream_fold(rows, [p["key"]], ["word_no"], _Windows(p["words"])), self._bags(), p["key"])
        rows = numbered(df.select(p["key"], p["order"], "word"), [p["key"]], [p["order"]])
        rows = rows.withColumn("window_no", F.floor((F.col("rn") - 1) / p["words"]))
        return classify(rows.select(p["key"], "window_no", "word"), self._bags(), p["key"], p["words"])

    def save(self, path: str) -> None:
        """One folder per class of `word;tfidf` lines, and the counts beside them."""
        self._bags().select("class", "word", "tfidf").write.mode("overwrite").partitionBy("class").option("sep", ";").csv(f"{path}/weights")
        self._bags().write.mode("overwrite").parquet(f"{path}/bags")

    def load(self, spark: SparkSession, path: str) -> SAXDictionary:
        return self.with_table(spark.read.parquet(f"{path}/bags"))

    def load_text(self, spark: SparkSession, path: str) -> SAXDictionary:
        """A model from the text files alone: it predicts as the saved one; counts (freq) are not in them."""
        return self.with_table(load_weights(spark, path).select("class", "word", F.lit(None).cast("bigint").alias("freq"), "tfidf"))


class _Windows(Fold):
    """The words of each full window of a key."""

    schema = "window_no bigint, words array<string>"

    def __init__(self, words: int):
        self.words = words

    def start(self):
        return 0, []

    def block(self, state, rows: pd.DataFrame):
        done, held = state
        held = [*held, *rows["word"].tolist()]
        full = len(held) // self.words
        out = [(done + k, held[k * self.words : (k + 1) * self.words]) for k in range(full)]
        return (done + full, held[full * self.words :]), pd.DataFrame(out, columns=["window_no", "words"])


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """class, word, tfidf of a saved dictionary's text files."""
    return spark.read.option("sep", ";").schema("word string, tfidf double, class string").csv(f"{path}/weights").select(F.col("class").cast("string").alias("class"), "word", "tfidf")


def weighted(counts: DataFrame) -> DataFrame:
    """class, word, freq with their TF-IDF weight."""
    classes = counts.agg(F.count_distinct("class").alias("c")).scalar()
    df = counts.groupBy("word").agg(F.count_distinct("class").alias("df"))
    out = counts.join(df, "word")
    return out.select("class", "word", "freq", (F.log1p(F.col("freq").cast("double")) * (1 + F.log(F.floor(classes / F.col("df")).cast("double")))).alias("tfidf"))


def classify(rows: DataFrame, bags: DataFrame, key: str, words: int) -> DataFrame:
    """key, window_no, class and similarity for each full window. rows: key, window_no, word."""
    counts = rows.groupBy(key, "window_no", "word").agg(F.count(F.lit(1)).cast("double").alias("c"))
    windows = counts.groupBy(key, "window_no").agg(F.sum("c").alias("n"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm")).where(F.col("n") == words)
    norms = bags.groupBy("class").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("class_norm"))
    weights = bags.join(norms, "class").select("class", "word", "tfidf", "class_norm")
    if weights.limit(MAX_BROADCAST_WORDS + 1).count() <= MAX_BROADCAST_WORDS:
        weights = F.broadcast(weights)
    dots = counts.join(weights, "word").groupBy(key, "window_no", "class", "class_norm").agg(F.sum(F.col("c") * F.col("tfidf")).alias("dot"))
    scored = dots.join(windows, [key, "window_no"]).select(key, "window_no", "class", F.when(F.col("class_norm") * F.col("norm") > 0, F.col("dot") / (F.col("class_norm") * F.col("norm"))).otherwise(0.0).alias("similarity"))
    # one pass over the scores: sums come in any order, and a second reckoning that rounds otherwise would lose its window
    top = F.min(F.struct((-F.round("similarity", 12)).alias("s"), "class", "similarity")).alias("top")
    ties = scored.groupBy(key, "window_no").agg(top).select(key, "window_no", "top.class", "top.similarity")
    # a window that shares no word with any class goes to the first class, with similarity 0
    first = bags.agg(F.min("class")).scalar()
    out = windows.join(ties, [key, "window_no"], "left")
    return out.select(key, "window_no", F.when(F.coalesce("similarity", F.lit(0.0)) > 0, F.col("class")).otherwise(first).alias("class"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def classify_windows(windows: DataFrame, bags: DataFrame, key: str) -> DataFrame:
    """The same for rows (key, window_no, words) of full windows, one by one, as in a stream; the dictionary is broadcast,
    and refused if it has more than MAX_BROADCAST_WORDS rows: then micro-batches (foreachBatch) can be classified."""
    held = bags.select("class", "word", "tfidf").limit(MAX_BROADCAST_WORDS + 1).collect()
    if len(held) > MAX_BROADCAST_WORDS:
        raise ValueError(f"a dictionary of more than {MAX_BROADCAST_WORDS} words is not broadcast: predict in foreachBatch")
    weights: dict[str, dict[str, float]] = {}
    for r in held:
        weights.setdefault(r["class"], {})[r.word] = r.tfidf
    shared = windows.sparkSession.sparkContext.broadcast(sorted(weights.items()))

    def run(frames):
        norms = [sum(x * x for x in words.values()) ** 0.5 for _, words in shared.value]
        for frame in frames:
            found = []
            for words in frame["words"]:
                counts: dict[str, int] = {}
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
                size = sum(c * c for c in counts.values()) ** 0.5
                best = (shared.value[0][0] if shared.value else None, 0.0)
                for (name, own), norm in zip(shared.value, norms):
                    dot = sum(c * own.get(w, 0.0) for w, c in counts.items())
                    s = dot / (size * norm) if size * norm > 0 else 0.0
                    if round(s, 12) > round(best[1], 12):
                        best = (name, s)
                found.append(best)
            yield frame[[key, "window_no"]].assign(**{"class": [c for c, _ in found], "similarity": [float(s) for _, s in found]})

    kind = windows.schema[key].dataType.simpleString()
    return windows.mapInPandas(run, f"`{key}` {kind}, window_no bigint, class string, similarity double")


__all__ = ["SAX", "SAXDictionary", "classify", "classify_windows", "cuts", "distance_matrix", "fit_stats", "letter", "load_weights", "weighted"]
