"""Aggregates with weights: quantiles, spreads, micro and macro averages, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_quantiles(df: DataFrame, value: str, weight: str, ps: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q_0, q_1, ...): the first value in order whose running weight reaches p of the total.

    Rows are first summed per distinct value, so that what is ordered grows with the values, not with the rows."""
    v = df.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("c", F.sum("w").over(run)).withColumn("t", F.sum("w").over(Window.partitionBy(*by)))
    return v.groupBy(*by).agg(*(F.min(F.when(F.col("c") >= p * F.col("t"), F.col("v"))).alias(f"q_{i}") for i, p in enumerate(ps)))


def spread(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean, median, mad, iqr), unweighted; quartiles interpolate."""
    med = df.groupBy(*by).agg(F.median(value).alias("__m"))
    both = df.join(med, list(by)) if by else df.crossJoin(F.broadcast(med))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return both.groupBy(*by).agg(F.avg(value).alias("mean"), F.first("__m").alias("median"), F.median(F.abs(F.col(value) - F.col("__m"))).alias("mad"), (q[1] - q[0]).alias("iqr"))


def weighted_spread(df: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean, median, mad, iqr) by weight; quantiles as in weighted_quantiles."""
    q = weighted_quantiles(df, value, weight, [0.25, 0.5, 0.75], by)
    both = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    both = both.withColumn("__d", F.abs(F.col(value) - F.col("q_1")))
    mad = weighted_quantiles(both, "__d", weight, [0.5], by).withColumnRenamed("q_0", "mad")
    mean = both.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.first("q_1").alias("median"), F.first(F.col("q_2") - F.col("q_0")).alias("iqr"))
    return (mean.join(mad, list(by)) if by else mean.crossJoin(mad)).select(*by, "mean", "median", "mad", "iqr")


def micro_macro(numerator: Column, denominator: Column, weight: Column | None = None, empty: float = 1.0) -> tuple[Column, Column]:
    """(micro, macro) as aggregate expressions: ratio of sums, and mean of ratios over non-zero denominators."""
    w = weight if weight is not None else F.lit(1.0)
    ok = denominator != 0
    micro = F.sum(F.when(ok, w * numerator)) / F.sum(F.when(ok, w * denominator))
    macro = F.sum(F.when(ok, w * numerator / denominator)) / F.sum(F.when(ok, w))
    return F.coalesce(micro, F.lit(empty)), F.coalesce(macro, F.lit(empty))


def nested_micro_macro(df: DataFrame, outer: str, numerator: str, denominator: str) -> DataFrame:
    """(micro_micro, micro_macro, macro_micro, macro_macro): how rows are averaged inside a group, then the groups."""
    n, d = F.col(numerator), F.col(denominator)
    g = df.groupBy(outer).agg(F.sum(n).alias("__n"), F.sum(d).alias("__d"), F.sum(n / d).alias("__r"), F.count("*").alias("__k"))
    g = g.withColumn("__micro", F.col("__n") / F.col("__d")).withColumn("__macro", F.col("__r") / F.col("__k"))
    sums = (F.sum("__n") / F.sum("__d")).alias("micro_micro"), (F.sum("__r") / F.sum("__k")).alias("macro_micro")
    return g.agg(*sums, F.avg("__micro").alias("micro_macro"), F.avg("__macro").alias("macro_macro"))


def mean_std(value: Column) -> tuple[Column, Column]:
    return F.avg(value), F.stddev_samp(value)


def precision_recall_f1(tp: Column, predicted: Column, relevant: Column) -> tuple[Column, Column, Column]:
    """Of summed counts; an empty denominator counts as 1, F1 of two zeros is 0."""
    p = F.when(predicted == 0, F.lit(1.0)).otherwise(tp / predicted)
    r = F.when(relevant == 0, F.lit(1.0)).otherwise(tp / relevant)
    return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def width_bins(df: DataFrame, value: Column, low: float, width: float, weight: Column | None = None) -> DataFrame:
    """(bin, share): relative weighted histogram with bins of equal width from low."""
    w = weight if weight is not None else F.lit(1.0)
    h = df.groupBy(F.floor((value - low) / width).alias("bin")).agg(F.sum(w).alias("n"))
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("t")))).select("bin", (F.col("n") / F.col("t")).alias("share"))


def bucket_average(df: DataFrame, keys: list[str], bucket: str, value: Column) -> DataFrame:
    """(keys, average, n): the mean over a key's buckets of an aggregate of each bucket, weighted by the bucket's rows."""
    per = df.groupBy(*keys, bucket).agg(value.cast("double").alias("__f"), F.count("*").alias("__w"))
    return per.groupBy(*keys).agg((F.sum(F.col("__f") * F.col("__w")) / F.sum("__w")).alias("average"), F.sum("__w").alias("n"))
