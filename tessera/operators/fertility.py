"""Fertility: how many pieces words get, and how many segmentations a vocabulary allows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ways(w: str, vocabulary: frozenset[str], most: int) -> int:
    ways = [1] + [0] * len(w)
    for j in range(1, len(w) + 1):
        ways[j] = sum(ways[i] for i in range(max(0, j - most), j) if ways[i] and w[i:j] in vocabulary)
    return ways[-1]


def log_segmentations(vocabulary: frozenset[str]):
    """Column -> double: base-2 logarithm of the ways to write a pretoken of any length; -inf if there's none."""
    most = max(map(len, vocabulary), default=0)

    @F.arrow_udf("double")
    def run(words: pa.Array) -> pa.Array:
        from math import inf, log2

        return pa.array([None if w is None else log2(n) if (n := _ways(w, vocabulary, most)) else -inf for w in words.to_pylist()], pa.float64())

    return run


def count_segmentations(vocabulary: frozenset[str]):
    """Column -> decimal(38,0): ways to write a pretoken as types of the vocabulary. Exact up to 2^126; null beyond."""
    most = max(map(len, vocabulary), default=0)

    @F.arrow_udf("decimal(38,0)")
    def run(words: pa.Array) -> pa.Array:
        from decimal import Decimal

        out = []
        for w in words.to_pylist():
            if w is None:
                out.append(None)
                continue
            ways = _ways(w, vocabulary, most)
            out.append(Decimal(ways) if ways < 10**38 else None)
        return pa.array(out, pa.decimal128(38, 0))

    return run


def segmentation_doubles(vocabulary: frozenset[str]):
    """Column -> struct<ways, log2_ways> of doubles, each word counted once. ways is infinite beyond doubles. Below 2^127 it is the sum of
    the doubles of its two 64-bit halves, as engines with 128-bit numbers turn them into doubles; beyond, the nearest double."""
    most = max(map(len, vocabulary), default=0)

    @F.arrow_udf("struct<ways: double, log2_ways: double>")
    def run(words: pa.Array) -> pa.Array:
        from math import inf, log2

        a, b = [], []
        for w in words.to_pylist():
            n = None if w is None else _ways(w, vocabulary, most)
            a.append(None if n is None else float(n >> 64) * 2.0**64 + float(n & (1 << 64) - 1) if n < 1 << 127 else float(n) if n.bit_length() <= 1023 else inf)
            b.append(None if n is None else log2(n) if n else -inf)
        return pa.StructArray.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["ways", "log2_ways"])

    return run


def inference_fertility(df: DataFrame, tokens: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of characters and tokens over distinct words and over all, with their ratios; a word is its joined tokens.

    segmentality is (tokens - 1) / (characters - 1), 1 for words of one character."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.size(tokens) > 0).select(*by, F.array_join(tokens, "").alias("word"), F.size(tokens).alias("k"), w.alias("w"))
    words = rows.groupBy(*by, "word").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("k")).alias("wk"), F.max("k").alias("k"))
    n = F.length("word")
    seg = F.when(n <= 1, F.lit(1.0)).otherwise((F.col("k") - 1) / (n - 1))
    s = words.groupBy(*by).agg(
        F.count("*").alias("types"), F.sum("w").alias("tokens"), F.sum(n).alias("type_chars"), F.sum(n * F.col("w")).alias("token_chars"),
        F.sum("k").alias("type_pieces"), F.sum("wk").alias("token_pieces"), F.avg(seg).alias("type_segmentality"), (F.sum(seg * F.col("w")) / F.sum("w")).alias("token_segmentality"),
    )
    return s.withColumn("type_fertility", F.col("type_pieces") / F.col("types")).withColumn("token_fertility", F.col("token_pieces") / F.col("tokens")).withColumn("type_cpt", F.col("type_chars") / F.col("type_pieces")).withColumn("token_cpt", F.col("token_chars") / F.col("token_pieces"))


def vocabulary_fertility(df: DataFrame, pretokens: str, vocabulary: frozenset[str], weight: str | None = None, most_chars: int = 100) -> DataFrame:
    """Segmentations per word, per character and over the largest possible number, for distinct words and weighted.

    df: one row per word with its pretokens. Pretokens are counted once each; words longer than most_chars are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    words = df.select(F.col(pretokens).alias("ps"), w.alias("w")).groupBy("ps").agg(F.sum("w").alias("w"))
    chars = F.length(F.array_join("ps", ""))
    words = words.where((chars > 0) & (chars <= most_chars)).withColumn("id", F.xxhash64(F.array_join("ps", "\x01")))
    parts = words.select("id", F.explode("ps").alias("p"))
    known = parts.select("p").distinct().withColumn("s", count_segmentations(vocabulary)(F.col("p")).cast("double"))
    product = parts.join(known, "p").groupBy("id").agg(F.product("s").alias("s"))
    both = words.join(product, "id").select("w", "s", chars.alias("c"), F.pow(F.lit(2.0), chars - F.size("ps")).alias("most"))
    return both.agg(
        F.avg("s").alias("type_per_word"), (F.sum("s") / F.sum("c")).alias("type_per_char"), F.avg(F.when(F.col("most") > 1, F.col("s") / F.col("most")).otherwise(1.0)).alias("type_ratio"),
        (F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("token_per_word"), (F.sum(F.col("s") * F.col("w")) / F.sum(F.col("c") * F.col("w"))).alias("token_per_char"),
    )


def histogram_inputs(tokens: Column) -> dict[str, Column]:
    """What the usual histograms bin: characters per token, segmentality, token count."""
    n, k = F.length(F.array_join(tokens, "")), F.size(tokens)
    return {"cpt": n / k, "segmentality": F.when(n <= 1, F.lit(1.0)).otherwise((k - 1) / (n - 1)), "pieces": k}
