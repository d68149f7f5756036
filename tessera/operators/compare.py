"""Comparison of two tokenisations of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import jaccard, split_positions
from tessera.operators.aggregates import micro_macro, precision_recall_f1


def exact_matches(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg((F.col(a) == F.col(b)).cast("double")), F.lit(1.0)).alias("exact"))


def token_jaccard(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(micro, macro) multiset Jaccard. Rows are compared within themselves, so nothing is shuffled but the sums."""
    both = F.array_distinct(F.concat(a, b))
    size = F.size(F.col(a)) + F.size(F.col(b))
    j = jaccard(F.col(a), F.col(b))
    # shared = size * j / (1 + j), since shared + united = size
    shared = F.round(size * j / (1 + j))
    rows = df.select(*by, shared.alias("s"), (size - shared).alias("u"), F.size(both).alias("d"))
    micro, macro = micro_macro(F.col("s"), F.col("u"))
    return rows.groupBy(*by).agg(micro.alias("micro"), macro.alias("macro"))


def multiplicity_ratio(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Token counts of a over b and of b over a; rows without tokens on a side are left out."""
    rows = df.select(*by, F.size(a).cast("double").alias("x"), F.size(b).cast("double").alias("y")).where("x > 0 and y > 0")
    return rows.groupBy(*by).agg((F.sum("x") / F.sum("y")).alias("micro_ab"), F.avg(F.col("x") / F.col("y")).alias("macro_ab"), (F.sum("y") / F.sum("x")).alias("micro_ba"), F.avg(F.col("y") / F.col("x")).alias("macro_ba"))


def split_confusion(df: DataFrame, candidate: str, reference: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(tp, predicted, relevant, total, precision, recall, f1) of split positions, weighted."""
    c, r = split_positions(F.col(candidate)), split_positions(F.col(reference))
    w = F.col(weight) if weight else F.lit(1)
    n = F.greatest(F.length(F.array_join(candidate, "")) - 1, F.lit(0))
    rows = df.select(*by, (w * F.size(F.array_intersect(c, r))).alias("tp"), (w * F.size(c)).alias("predicted"), (w * F.size(r)).alias("relevant"), (w * n).alias("total"))
    sums = rows.groupBy(*by).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "predicted", "relevant", "total")))
    p, q, f = precision_recall_f1(F.col("tp"), F.col("predicted"), F.col("relevant"))
    return sums.select(*by, "tp", "predicted", "relevant", "total", p.alias("precision"), q.alias("recall"), f.alias("f1"))
