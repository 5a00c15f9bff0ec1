"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Method: labelled documents are halved by a hash of doc_id. One half proposes a grid of cutoffs per rule; the other,
the holdout, certifies them. For a stratum and a rule, cutoffs are tried from the loosest to the strictest, and one
is certified while the exact binomial (Clopper-Pearson) upper bound of its false rejection rate among good documents
stays below the rule's share of `risk`: P(Bin(n, risk / rules) <= k) <= confidence share. The sequence stops at the
first cutoff that fails (fixed-sequence testing), and the chains of all strata and rules share `alpha` (Bonferroni).
Of the certified cutoffs the one with the best gain on the proposing half is taken; without a gain the rule is off.

Defined results: a null text has no words; a null stratum is a stratum of its own; labels with a null or repeated
doc_id, or with contradicting values, are left out; without labels only the base rules hold. Repeated rows are
judged alike. Empty tables give empty results; other columns are kept by `apply_rules` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WS, WS_CLASS, let

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Rules: a ratio of features; high values are bad.
RULES = {
    "symbol_ratio": ("n_symbols", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_text_lines"),
}
#: More strata than this are joined by an exchange and not by a broadcast.
MAX_BROADCAST_STRATA = 10_000


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more, in O(n log n) and exact.

    Windows are hashed, the low bits of each hash replaced by its position, and sorted as plain longs; neighbours with
    equal high bits are candidates, and only those are compared as strings.
    """

    def neighbours(s: Column, same) -> Column:
        return F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))

    def of(w: Column) -> Column:
        def with_bits(b: Column) -> Column:
            def packed(i: Column) -> Column:
                high = F.call_function("shiftright", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b)
                return F.call_function("shiftleft", high, b).bitwiseOR(i.cast("long"))

            high = lambda x: F.call_function("shiftright", x, b)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
            candidates = let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed)), lambda s: neighbours(s, lambda x, y: high(x) == high(y)))
            named = F.transform(candidates, lambda x: let(x.bitwiseAND(mask).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("k"), p.alias("p"))))
            repeated = let(F.sort_array(named), lambda e: F.sort_array(F.transform(neighbours(e, lambda x, y: x["k"] == y["k"]), lambda x: x["p"])))
            return F.aggregate(
                repeated,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(F.size(w))), with_bits))

    return of(words)


def features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash and the counts of every whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(WS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS_CLASS}]+"))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    dups = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_text_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n = F.char_length(t)
    out = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(stratum).alias("stratum"),
        F.xxhash64(t).alias("text_hash"),
        F.char_length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
        (n - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        counts.alias("__c"),
        dups.alias("__d"),
    )
    return out.select("doc_id", "stratum", "text_hash", "__c.n_words", "word_chars", "n_symbols", "__d.n_dup_lines", "__c.n_repeat_words", "__d.n_text_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    a, b = RULES[rule]
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(0.0)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in order from log terms; no inverse beta function is needed for the bound."""
    import math

    odds = math.log(p / (1 - p))
    t0 = n.cast("double") * math.log1p(-p)

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1).cast("double") / j.cast("double")) + F.lit(odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    start = F.struct(t0.alias("t"), F.exp(t0).alias("s"))
    return F.when(k <= 0, F.exp(t0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step, lambda acc: acc["s"]))


def fit_cutoffs(feats: DataFrame, labels: DataFrame, *, good: str = "quality", label_id: str = "doc_id", risk: float = 0.05, alpha: float = 0.05, grid: int = 32, false_cost: float = 5.0) -> DataFrame:
    """Per stratum a column for each rule: reject above it (null: the rule is off there)."""
    clean = labels.select(F.col(label_id).alias("__id"), F.col(good).cast("int").alias("__good")).where("__id is not null and __good is not null")
    clean = clean.groupBy("__id").agg(F.min("__good").alias("__good"), F.count_distinct("__good").alias("__kinds")).where("__kinds = 1").drop("__kinds")
    rows = feats.where(~base_failed()).join(clean, feats["doc_id"] == clean["__id"])
    rows = rows.select("stratum", "__good", (F.substring(F.md5(F.concat(F.lit("holdout:"), F.col("doc_id").cast("string"))), 1, 1) < "8").alias("holdout"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r).alias("value")) for r in RULES])).alias("x"))
    rows = rows.select("stratum", "__good", "holdout", "x.rule", "x.value")
    # the sums by distinct value are small: whatever follows reads these, not documents
    rows = rows.groupBy("stratum", "rule", "holdout", "__good", "value").agg(F.count(F.lit(1)).alias("n"))
    qs = F.array(*[F.lit(i / grid) for i in range(1, grid)])
    cuts = rows.where("not holdout").groupBy("rule").agg(F.array_distinct(F.percentile("value", qs, F.col("n"))).alias("cuts"))
    cuts = cuts.select("rule", F.explode(F.array_union(F.col("cuts"), F.array(F.lit(0.0)))).alias("cutoff"))
    tested = rows.join(F.broadcast(cuts), "rule").groupBy("stratum", "rule", "cutoff").agg(
        F.sum(F.when(F.col("holdout") & (F.col("__good") == 1), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("holdout") & (F.col("__good") == 1) & (F.col("value") > F.col("cutoff")), F.col("n")).otherwise(0)).alias("k_good"),
        F.sum(F.when(~F.col("holdout") & (F.col("__good") == 1) & (F.col("value") > F.col("cutoff")), F.col("n")).otherwise(0)).alias("fit_good"),
        F.sum(F.when(~F.col("holdout") & (F.col("__good") != 1) & (F.col("value") > F.col("cutoff")), F.col("n")).otherwise(0)).alias("fit_bad"),
    )
    chains = tested.select("stratum").distinct().agg((F.count(F.lit(1)) * len(RULES)).alias("chains"))
    share = risk / len(RULES)
    passes = F.when(F.col("n_good") > 0, binomial_cdf(F.col("k_good"), F.col("n_good"), share)).otherwise(1.0) <= F.lit(alpha) / chains.scalar()
    chain = Window.partitionBy("stratum", "rule").orderBy(F.col("cutoff").desc()).rowsBetween(Window.unboundedPreceding, 0)
    certified = tested.withColumn("ok", F.min(passes.cast("int")).over(chain)).where("ok = 1")
    gain = F.col("fit_bad") - false_cost * F.col("fit_good")
    best = certified.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """feats with the cutoffs of its stratum, base_failed and kept."""
    cutoffs = cutoffs.withColumnRenamed("stratum", "__stratum")
    if cutoffs.limit(MAX_BROADCAST_STRATA + 1).count() <= MAX_BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    out = feats.join(cutoffs, feats["stratum"].eqNullSafe(cutoffs["__stratum"]), "left").drop("__stratum")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected})


def apply_rules(docs: DataFrame, verdicts: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose verdict is kept, with the columns of docs."""
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__v_id"), F.col("text_hash").alias("__v_hash")).distinct()
    own = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    on = own["__text_hash"].eqNullSafe(gone["__v_hash"]) & own[doc_id].eqNullSafe(gone["__v_id"])
    return own.join(gone, on, "left_anti").drop("__text_hash")
