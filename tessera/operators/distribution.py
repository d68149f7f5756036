"""Unigram distributions and their diversity: type/token ratio, Shannon and Rényi entropy, Rényi efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unigram(tokens: DataFrame, by: tuple[str, ...] = (), token: str = "token", weight: str | None = None) -> DataFrame:
    """(by, token, n): summed weights."""
    return tokens.groupBy(*by, token).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def ensured(counts: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """counts with a row of 0 for every type of the vocabulary that wasn't seen."""
    return vocabulary.select(token).join(counts, token, "full").withColumn("n", F.coalesce("n", F.lit(0)))


def ttr(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, types, tokens, ttr) over types that occur."""
    seen = counts.where("n > 0")
    return seen.groupBy(*by).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).withColumn("ttr", F.col("types") / F.col("tokens"))


def shannon(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, entropy): base 2, from sums that combine before the shuffle: log T - sum(n log n) / T."""
    n = F.col("n").cast("double")
    s = counts.where("n > 0").groupBy(*by).agg(F.sum(n).alias("t"), F.sum(n * F.log2(n)).alias("s"))
    return s.select(*by, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def renyi(counts: DataFrame, alpha: float = 2.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, entropy, types, tokens): log2(sum p^alpha) / (1 - alpha); Shannon's at alpha 1."""
    n = F.col("n").cast("double")
    some = counts.where("n > 0").groupBy(*by)
    if alpha == 1:
        s = some.agg(F.sum(n).alias("tokens"), F.sum(n * F.log2(n)).alias("s"), F.count("*").alias("types"))
        entropy = F.log2("tokens") - F.col("s") / F.col("tokens")
    else:
        s = some.agg(F.sum(n).alias("tokens"), F.sum(F.pow(n, F.lit(alpha))).alias("s"), F.count("*").alias("types"))
        entropy = (F.log2("s") - alpha * F.log2("tokens")) / (1 - alpha)
    return s.select(*by, entropy.alias("entropy"), "types", "tokens")


def efficiency(entropy: Column, domain: Column, sample: Column) -> tuple[Column, Column, Column]:
    """(lower, middle, upper): entropy over ceil(H0), over H0, and ceil(entropy) over H0, where H0 = log2(min(domain, sample)).

    Nothing to choose from (domain 0 or 1) is fully efficient; no or one observation isn't at all."""
    top = F.log2(F.least(domain, sample).cast("double"))

    def ladder(value: Column) -> Column:
        one, zero = F.lit(1.0), F.lit(0.0)
        return F.when(domain == 0, one).when(sample == 0, zero).when(domain == 1, one).when(sample == 1, zero).otherwise(value)

    return ladder(entropy / F.ceil(top)), ladder(entropy / top), ladder(F.ceil(entropy) / top)


def renyi_efficiency(counts: DataFrame, alpha: float = 2.5, by: tuple[str, ...] = (), domain: int | None = None) -> DataFrame:
    """(by, lower, middle, upper): domain is the vocabulary's size, or the number of types that occur."""
    h = renyi(counts, alpha, by)
    low, mid, high = efficiency(F.col("entropy"), F.lit(domain) if domain is not None else F.col("types"), F.col("tokens"))
    return h.select(*by, low.alias("lower"), mid.alias("middle"), high.alias("upper"))


def normalised(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """counts with p = n / total, the totals joined back (no single-task window)."""
    if not by:
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("p", F.col("n") / F.col("total")).drop("total")
    return counts.join(counts.groupBy(*by).agg(F.sum("n").alias("total")), list(by)).withColumn("p", F.col("n") / F.col("total")).drop("total")


def argmax(counts: DataFrame, k: int = 1) -> DataFrame:
    """All tokens at the k-th largest count."""
    level = counts.select("n").distinct().orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count("*").alias("c")).where(F.col("c") == k).select("n")
    return counts.join(F.broadcast(level), "n").select("token", "n")


def segmentations(tokens: DataFrame, word: str, pieces: str) -> DataFrame:
    """(word, mask, n): how often each word was cut in each way; mask has a 1 where a piece begins inside the word."""
    mask = F.array_join(F.transform(pieces, lambda t: F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(t) - 1))), "")
    return tokens.where(F.size(pieces) > 0).select(word, F.substring(mask, F.lit(2), F.length(mask)).alias("mask")).groupBy(word, "mask").agg(F.count("*").alias("n"))


def segmentation_diversity(seg: DataFrame, word: str = "word", alpha: float = 1.0) -> DataFrame:
    """Per word: distinct cuts over samples and over all possible cuts, the share that isn't the commonest, efficiency."""
    h = renyi(seg, alpha, (word,)).withColumnRenamed("types", "k")
    top = seg.groupBy(word).agg(F.max("n").alias("most"), F.max(F.length("mask")).alias("bits"))
    both = h.join(top, word)
    domain = F.pow(F.lit(2.0), "bits")
    mid = efficiency(F.col("entropy"), domain, F.col("tokens"))[1]
    unique, coverage = F.col("k") / F.col("tokens"), F.col("k") / domain
    return both.select(word, "k", unique.alias("uniqueness"), coverage.alias("coverage"), F.greatest(unique, coverage).alias("diversity"), (1 - F.col("most") / F.col("tokens")).alias("regularisation"), mid.alias("efficiency"))
