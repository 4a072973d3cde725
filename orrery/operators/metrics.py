"""Scores, attributions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or an error if it is not finite."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a number is not finite"))).otherwise(c)


def finance_variance(facts: DataFrame) -> DataFrame:
    """Revenue less budget by region and period, nulls as 0; only positive amounts are outstanding."""
    zero = F.lit(0.0)
    return facts.groupBy("region", "period").agg(
        (F.sum(F.coalesce(finite(F.col("revenue")), zero)) - F.sum(F.coalesce(finite(F.col("budget")), zero))).alias("variance"),
        F.sum(F.when(F.col("outstanding") > 0, F.col("outstanding")).otherwise(zero)).alias("outstanding"),
    )


def attribution(iterations: DataFrame, changes: DataFrame) -> DataFrame:
    """Per asset, mean score before and from its first change, improvement, confidence min(max(n, 1) * 0.2, 1).

    iterations(run, number, score), changes(run, number, asset, change_type).
    """
    first = changes.groupBy("run", "asset").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n_changes"))
    joined = iterations.join(first, "run")
    after = F.col("number") >= F.col("first")
    out = joined.groupBy("run", "asset").agg(F.avg(F.when(~after, F.col("score"))).alias("before"), F.avg(F.when(after, F.col("score"))).alias("after"), F.max("n_changes").alias("n_changes"))
    out = out.withColumn("improvement", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    return out.withColumn("confidence", F.least(F.greatest("n_changes", F.lit(1)) * 0.2, F.lit(1.0)))


def weighted_score(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Sum of dimension * weight, to two places."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in sorted(weights.items())), F.lit(0.0))
    return df.withColumn(out, F.round(total, 2))


def buckets(df: DataFrame, text_col: str, rules: list[tuple[str, list[str]]], other: str = "other") -> DataFrame:
    """The first bucket, in order, one of whose keywords is in the text; counts by bucket."""
    choose, low = F.when(F.lit(False), F.lit(None).cast("string")), F.lower(F.col(text_col))
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        choose = choose.when(hit, name)
    return df.groupBy(choose.otherwise(other).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def pass_rates(df: DataFrame, by: str, checks: list[str]) -> DataFrame:
    """Share of rows that pass each check, and all."""
    every = F.lit(True)
    for c in checks:
        every = every & F.col(c)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("int")).alias(c) for c in checks], F.avg(every.cast("int")).alias("all_checks"))


def stability(old: DataFrame, new: DataFrame, class_col: str, item_col: str) -> DataFrame:
    """By class, items now, share of new ones, and the symmetric difference over the union."""
    a = old.select(class_col, item_col).distinct().withColumn("was", F.lit(1))
    b = new.select(class_col, item_col).distinct().withColumn("now", F.lit(1))
    both = a.join(b, [class_col, item_col], "full_outer")
    out = both.groupBy(class_col).agg(F.count("now").alias("n"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.count(F.lit(1)).alias("either"))
    return out.select(class_col, "n", F.when(F.col("n") > 0, F.col("added") / F.col("n")).otherwise(0.0).alias("saturation_gap"), ((F.col("added") + F.col("removed")) / F.col("either")).alias("instability"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def review_summary(reviews: DataFrame) -> DataFrame:
    """States and findings over the latest review of each resource."""
    now = latest(reviews, ["resource"], [F.desc("ts"), F.desc("review_id")])
    return now.groupBy("state").agg(F.count(F.lit(1)).alias("resources"), F.sum("findings").alias("findings"), F.sum("waived").alias("waived"), F.sum(F.col("findings") - F.col("waived")).alias("unresolved"))


def feedback(df: DataFrame, low: float, terms_col: str = "terms") -> DataFrame:
    """Terms of low-scored answers that the answer lacks; confidence 0.6 * mean + 0.4 * min(n / 10, 1)."""
    hits = df.where(F.col("score") < low).withColumn("term", F.explode(terms_col))
    hits = hits.where(~F.lower("answer").contains(F.lower("term")))
    out = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return out.select("term", "n", (0.6 * F.col("mean") + 0.4 * F.least(F.col("n") / 10, F.lit(1.0))).alias("confidence"))


def health(stats: DataFrame) -> DataFrame:
    """100 less 20 a critical and 10 a warning, not below 0. stats(graph, nodes, edges, orphans, components)."""
    density = F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))
    critical = (F.col("nodes") == 0).cast("int") + (F.col("orphans") > 0.5 * F.col("nodes")).cast("int")
    warning = (F.coalesce(density, F.lit(0.0)) < 0.001).cast("int") + (F.col("orphans").between(F.col("nodes") * 0.1, F.col("nodes") * 0.5)).cast("int") + (F.col("components") > 10).cast("int")
    return stats.select("graph", critical.alias("critical"), warning.alias("warning"), F.greatest(F.lit(0), 100 - 20 * critical - 10 * warning).alias("health"))
