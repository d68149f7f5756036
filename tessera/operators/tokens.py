"""Token tables: one row per token, with weights and positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted(df: DataFrame, weight: str | None = None) -> DataFrame:
    """df with a weight column: the given one, 1 where it is null or there is none."""
    return df.withColumn("weight", F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0))


def repeated(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, numbered from 0 (to sample stochastic operators)."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def explode_tokens(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """keep columns, pos within the row (from 0) and token. Null or empty token lists give no rows."""
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def pretokens(df: DataFrame, split: Callable[[Column], Column], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return explode_tokens(df, split(F.col(text)), *keep)


def positions(df: DataFrame, tokens: Column, order: str = "doc_id", by: tuple[str, ...] = (), span: int = 4096) -> DataFrame:
    """Tokens with gpos, their place in the stream of all rows by `order` (per group of `by`), without sorting tokens.

    Rows are first summed per span of the order, so that no window holds more than a span's rows or all spans' sums."""
    rows = df.withColumn("__t", tokens).withColumn("__n", F.coalesce(F.size("__t"), F.lit(0))).withColumn("__s", F.floor(F.col(order) / span))
    spans = rows.groupBy(*by, "__s").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__base", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inside = Window.partitionBy(*by, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__off", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(spans, [*by, "__s"])
    out = rows.select(*by, order, (F.col("__base") + F.col("__off")).alias("__start"), F.posexplode("__t").alias("pos", "token"))
    return out.withColumn("gpos", F.col("__start") + F.col("pos")).drop("__start")


def memoised(df: DataFrame, kernel: Callable[[Column], Column], pretoken: str = "pretoken", out: str = "tokens") -> DataFrame:
    """df with kernel(pretoken): computed once per distinct pretoken, joined back. For Python kernels over Zipfian text."""
    known = df.select(pretoken).where(F.col(pretoken).isNotNull()).distinct().withColumn(out, kernel(F.col(pretoken)))
    return df.join(known, pretoken, "left")


def any_token_of(df: DataFrame, tokens: str, wanted: list[str]) -> DataFrame:
    """Rows that hold a token of the set."""
    return df.where(F.arrays_overlap(tokens, F.array(*map(F.lit, wanted))))


def by_hash(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of seed and key: the same wherever the row is."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def bernoulli(df: DataFrame, key: str, p: float, complement: bool = False, seed: int = 0) -> DataFrame:
    """Every row with probability p, drawn by its key; complement: the others."""
    u = by_hash(F.col(key), seed)
    return df.where(u >= p if complement else u < p)


def take(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def drop(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(n)


def unzipped(df: DataFrame, key: str, *parts: str) -> list[DataFrame]:
    """A table per part, each with the key, for consumers of their own."""
    return [df.select(key, p) for p in parts]


def recombined(parts: list[DataFrame], key: str) -> DataFrame:
    """The parts of `unzipped`, as their consumers left them, by the key; a row that one of them dropped is gone."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


def seconds_per_row(df: DataFrame, laps: int = 3) -> tuple[int, list[float]]:
    """(rows, seconds of each lap): the whole plan, written nowhere; the first lap warms up and doesn't count."""
    from time import perf_counter

    took = []
    for _ in range(laps + 1):
        began = perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(perf_counter() - began)
    return df.count(), took[1:]
