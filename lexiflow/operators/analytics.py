"""Evaluation analytics: accuracies, confusion, quantiles by index, paired deltas, exact tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(correct: Column) -> Column:
    """Share of true among all rows; unscorable rows count as wrong."""
    return F.avg(F.coalesce(correct, F.lit(False)).cast("int"))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """gold, predicted, n over all pairs of labels that occur on either side (zeros included)."""
    pairs = df.filter(f"{gold} is not null and {predicted} is not null")
    labels = pairs.select(F.col(gold).alias("l")).union(pairs.select(F.col(predicted).alias("l"))).distinct()
    n = pairs.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = labels.select(F.col("l").alias("gold")).join(F.broadcast(labels.select(F.col("l").alias("predicted"))), F.lit(True))  # labels, a few
    return grid.join(n, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def f1_scores(matrix: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 from a confusion table."""
    c = matrix.groupBy("gold").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n"))).alias("hit"))
    p = matrix.groupBy(F.col("predicted").alias("gold")).agg(F.sum("n").alias("called"))
    both = c.join(p, "gold", "full").select(F.coalesce("support", F.lit(0)).alias("s"), F.coalesce("hit", F.lit(0)).alias("h"), F.coalesce("called", F.lit(0)).alias("c"))
    f1 = F.when(F.col("s") + F.col("c") > 0, 2 * F.col("h") / (F.col("s") + F.col("c"))).otherwise(0.0)
    return both.agg((F.sum("h") / F.sum("s")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("s")) / F.sum("s")).alias("weighted_f1"))


def index_quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, least, greatest and the sorted values at a quarter, half and three quarters of the count (no
    interpolation). Nulls do not count; a group without a value has nulls, null is a group of its own.

    Values are counted first, so what is ranked are a group's distinct values, one row each; none is gathered."""
    counted = df.groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    w = Window.partitionBy("_by").orderBy(F.col("_v").asc_nulls_first())
    c = counted.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_by")))
    at = lambda k: F.max(F.when((F.col("_upto") > F.floor(F.col("_all") * k / 4)) & (F.col("_upto") - F.col("_n") <= F.floor(F.col("_all") * k / 4)), F.col("_v")))
    mean = F.try_divide(F.sum(F.col("_v") * F.col("_n")), F.sum("_n"))
    return c.groupBy(F.col("_by").alias(by)).agg(mean.alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


def prf(sets: DataFrame) -> DataFrame:
    """Precision, recall, F1 of (q, got: array, wanted: array) with guarded denominators."""
    hit = F.size(F.array_intersect("got", "wanted"))
    p, r = hit / F.greatest(F.size("got"), F.lit(1)), hit / F.greatest(F.size("wanted"), F.lit(1))
    return sets.select("q", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-10))).alias("f1"))


def matched_deltas(runs: DataFrame, factor: str, on: str, off: str, others: list[str], value: str) -> DataFrame:
    """One row per setting of the other factors that has both levels: the difference of the values."""
    best = runs.groupBy(*others, factor).agg(F.max(value).alias("_value"))
    wide = best.groupBy(*others).agg(F.max(F.when(F.col(factor) == on, F.col("_value"))).alias("with"), F.max(F.when(F.col(factor) == off, F.col("_value"))).alias("without"))
    return wide.filter("with is not null and without is not null").withColumn("delta", F.col("with") - F.col("without"))


def delta_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean"), F.expr("percentile(delta, 0.5)").alias("median"), F.count_if(F.col("delta") > 0).alias("positive"), F.count_if(F.col("delta") < 0).alias("negative"))


def latest_of(runs: DataFrame, by: list[str], version: Column, value: str, elapsed: str) -> DataFrame:
    """The row of each group with the highest version, then the best value, then the least time."""
    w = Window.partitionBy(*by).orderBy(F.desc(version), F.desc(value), F.asc(elapsed))
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def binomial_tail(n: int, k: int) -> float:
    """Twice the probability of ``k`` or fewer of ``n`` at one half, at most 1.

    Terms fall from the ``k``th on, each from the one before it, and are added up until they no longer count: some
    multiples of the root of n, in floating point (relative error about 1e-15 times the logarithm of n's factorial)."""
    import math

    if n == 0:
        return 1.0
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, 2 * total * math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)))


def mcnemar(n01: Column, n10: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the smaller binomial tail at one half, at most 1."""

    @F.pandas_udf("double")
    def p(a, b):
        import pandas as pd

        return pd.Series([binomial_tail(int(x + y), int(min(x, y))) for x, y in zip(a, b, strict=True)])

    return p(n01.cast("long"), n10.cast("long"))


def bootstrap(pairs: DataFrame, by: str, a: str, b: str, samples: int = 3000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean difference over seeded resamples of each group's counts of differences.

    Differences of two truths are -1, 0 or 1, so a resample is a multinomial draw from three counts; no rows are held.
    """
    counts = pairs.groupBy(by).agg(*[F.count_if((F.col(a).cast("int") - F.col(b).cast("int")) == d).alias(n) for d, n in ((-1, "lost"), (0, "same"), (1, "won"))])

    def draw(key, pdf):
        import numpy as np
        import pandas as pd

        c = pdf[["lost", "same", "won"]].to_numpy()[0].astype(float)
        n = int(c.sum())
        x = np.random.default_rng(seed).multinomial(n, c / n, size=samples)
        d = np.sort((x[:, 2] - x[:, 0]) / n)
        return pd.DataFrame({by: [key[0]], "delta": [(c[2] - c[0]) / n], "low": [d[int(0.025 * samples)]], "high": [d[int(0.975 * samples)]]})

    kind = pairs.schema[by].dataType.simpleString()
    return counts.groupBy(by).applyInPandas(draw, f"{by} {kind}, delta double, low double, high double")


def paired(first: DataFrame, second: DataFrame, key: str = "row_id", correct: str = "is_correct") -> DataFrame:
    """key, a, b: whether each row is correct in either run; rows that one run lacks go."""
    return first.select(key, F.col(correct).alias("a")).join(second.select(key, F.col(correct).alias("b")), key)


def pairwise(pairs: DataFrame, samples: int = 3000, seed: int = 42) -> DataFrame:
    """One row: accuracies of both runs, their difference (also in percent of the first), the exact p of discordant
    pairs and the interval of the difference."""
    c = pairs.agg(F.count("*").alias("n"), accuracy(F.col("a")).alias("first"), accuracy(F.col("b")).alias("second"), F.count_if(~F.col("a") & F.col("b")).alias("n01"), F.count_if(F.col("a") & ~F.col("b")).alias("n10"))
    delta = F.col("second") - F.col("first")
    c = c.select("*", delta.alias("delta"), F.when(F.col("first") != 0, 100 * delta / F.col("first")).alias("relative"), mcnemar(F.col("n01"), F.col("n10")).alias("p"))
    interval = bootstrap(pairs.withColumn("_all", F.lit(0)), "_all", "b", "a", samples, seed).select("low", "high")
    return c.join(F.broadcast(interval), F.lit(True), "left")  # one row each


def transitions(pairs: DataFrame) -> DataFrame:
    """``pairs`` with how a row went from the first run to the second."""
    return pairs.withColumn("transition", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "lost").when(F.col("b"), "won").otherwise("neither"))


def split_accuracy(df: DataFrame, has_context: Column, correct: Column) -> DataFrame:
    """Accuracies of rows with and without context; 0 where there are none."""
    part = lambda on: F.coalesce(F.avg(F.when(on, F.coalesce(correct, F.lit(False)).cast("int"))), F.lit(0.0))
    return df.agg(part(has_context).alias("with_context"), part(~has_context).alias("without_context"), F.count_if(has_context).alias("n_with"))


def by_model(df: DataFrame, domain: str, model: str = "model", correct: str = "is_correct") -> DataFrame:
    return df.groupBy(model, domain).agg(F.count("*").alias("n"), accuracy(F.col(correct)).alias("accuracy"))


def over_models(detail: DataFrame, domain: str) -> DataFrame:
    """Mean, best, worst and spread (of the population) of the models' accuracies in each domain."""
    a = F.col("accuracy")
    return detail.groupBy(domain).agg(F.avg(a).alias("mean"), F.max(a).alias("best"), F.min(a).alias("worst"), F.stddev_pop(a).alias("std"), F.count("*").alias("models"))


def pair_details(runs: DataFrame, factor: str, on: str, off: str, others: list[str], value: str) -> DataFrame:
    """The matched pairs of ``matched_deltas`` with a running number in the order of their settings.

    Settings are combinations of factors of an experiment, a table that one task can number."""
    return matched_deltas(runs, factor, on, off, others, value).withColumn("pair_id", F.row_number().over(Window.orderBy(*others)))


def key_rows(runs: DataFrame, predicates: dict[str, str], value: str, ties: list[str]) -> DataFrame:
    """The best row that meets each predicate, under its name; ties go to the least of ``ties``. Every row is dealt to
    the predicates that it meets and only one per name crosses the shuffle."""
    met = F.filter(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in predicates.items()]), lambda n: n.isNotNull())
    rows = runs.select("*", F.explode(met).alias("method"))
    return rows.groupBy("method").agg(F.min_by(F.struct(*[F.col(c) for c in runs.columns]), F.struct(-F.col(value), *ties)).alias("r")).select("method", "r.*")


def token_statistics(df: DataFrame, fields: dict[str, Column], limit: int) -> DataFrame:
    """field, n, mean, most, over (the limit) of the token counts of several fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("long").alias("t")) for n, c in fields.items()])).alias("p")
    return df.select(pairs).groupBy("p.field").agg(F.count("*").alias("n"), F.avg("p.t").alias("mean"), F.max("p.t").alias("most"), F.count_if(F.col("p.t") > limit).alias("over"))


def approval(df: DataFrame, by: str, approved: Column) -> DataFrame:
    """Rows, share approved among those with a verdict, and rows without one, of each group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(approved.cast("int")).alias("approved"), F.count_if(approved.isNull()).alias("errors"))


def sound_reasoning(df: DataFrame, reasoning: str, tokens: Column, most: int, error: str = "api error", correct: str = "is_correct") -> DataFrame:
    """Rows that are not marked wrong and have a reasoning without an error, of at most so many tokens."""
    text = F.coalesce(F.col(reasoning), F.lit(""))
    return df.filter(F.coalesce(F.col(correct), F.lit(True)) & (F.trim(text) != "") & ~F.lower(text).contains(error) & (tokens <= most))
