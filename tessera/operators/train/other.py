"""N-gram, word-count, LZW, derivational and entropy-constrained vocabularies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_words(pretokens: DataFrame, word: str = "pretoken", weight: str | None = None, least: int = 1) -> DataFrame:
    """(word, count), exact; the shuffle spills where the reference would shard."""
    w = F.sum(weight).cast("long") if weight else F.count("*")
    return pretokens.groupBy(F.col(word).alias("word")).agg(w.alias("count")).where(F.col("count") >= least)


def ngram_counts(words: DataFrame, n_max: int, least: int, n_min: int = 1) -> DataFrame:
    """(n, gram, count) of words (word, count): an n-gram is looked at if its first or last n - 1 characters survived."""
    from tessera.sources.artifacts import checkpoint

    grams = lambda n: words.where(F.length("word") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substring("word", i, F.lit(n)))).alias("gram"), "count")
    out, before = None, None
    for n in range(1, n_max + 1):
        g = grams(n)
        if before is not None:
            cut = F.length("gram") - 1
            head = g.join(before, F.substring("gram", F.lit(1), cut) == before["g"], "left_semi")
            tail = g.join(before, F.substring("gram", F.lit(1), cut) == before["g"], "left_anti").join(before, F.substring("gram", F.lit(2), cut) == before["g"], "left_semi")
            g = head.unionByName(tail)
        # written, since the next length looks at it three times, and that one's at it again
        kept = checkpoint(g.groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") >= least))
        before = kept.select(F.col("gram").alias("g"))
        if n >= n_min:
            part = kept.select(F.lit(n).alias("n"), "gram", "count")
            out = part if out is None else out.unionByName(part)
    return out


def ngram_vocabulary(words: DataFrame, size: int, n_max: int, least: int = 1, n_min: int = 1, seed: int | None = None) -> DataFrame:
    """(rank, type): the commonest (or, with a seed, drawn by count without replacement), in order of length and type."""
    c = ngram_counts(words, n_max, least, n_min)
    if seed is None:
        top = c.orderBy(F.desc("count"), "gram").limit(size)
    else:  # exponential clocks: the first `size` to ring are a draw proportional to the counts
        u = (F.pmod(F.xxhash64(F.lit(seed), "gram"), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
        top = c.orderBy(-F.log(u) / F.col("count"), "gram").limit(size)
    from pyspark.sql.window import Window

    return top.select((F.row_number().over(Window.orderBy(F.length("gram"), "gram")) - 1).alias("rank"), F.col("gram").alias("type"))


def lzw(pretokens: list[str] | object, size: int | None = None) -> list[str]:
    """Vocabulary of LZ78-style passes over pretokens in corpus order: a chunk that was a candidate becomes a type, and with the next
    piece a candidate; pretokens are rewritten to chunks; the end is the size, or a pass that adds nothing. Sequential by nature."""
    texts = [list(p) for p in pretokens]
    vocab = dict.fromkeys(sorted({c for t in texts for c in t}))
    candidates = set(vocab)
    while True:
        before = len(vocab)
        for k, pieces in enumerate(texts):
            out, i = [], 0
            while i < len(pieces):
                chunk, j = pieces[i], i + 1
                while j < len(pieces) and chunk + pieces[j] in candidates:
                    chunk += pieces[j]
                    j += 1
                if chunk not in vocab:
                    vocab[chunk] = None
                    if size is not None and len(vocab) >= size:
                        return list(vocab)
                if j < len(pieces):
                    candidates.add(chunk + pieces[j])
                out.append(chunk)
                i = j
            texts[k] = out
        if len(vocab) == before:
            return list(vocab)


def stems_coarse(types: DataFrame, least_length: int) -> DataFrame:
    return types.where(F.length("type") >= least_length)


def stems_fine(stems: DataFrame, words: DataFrame, prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """Stems that some word of the corpus has with an affix."""
    bare = [F.when(F.col("word").startswith(p), F.substring("word", F.lit(len(p) + 1), F.length("word"))) for p in prefixes]
    bare += [F.when(F.col("word").endswith(s), F.substring("word", F.lit(1), F.length("word") - len(s))) for s in suffixes]
    seen = words.select(F.explode(F.array_compact(F.array(*bare))).alias("type")).distinct()
    return stems.join(seen, "type", "left_semi")


def boundary_blame(df: DataFrame, tokens: str, morphs: str) -> DataFrame:
    """(type, right, wrong, ratio): how often a token crosses a morph boundary; the trainer bypasses types above a ratio of 0.5."""
    from tessera.functions.scalars import token_starts
    from tessera.operators.morphology import spans

    cuts = token_starts(F.col(morphs))
    rows = df.select(F.explode(spans(F.col(tokens))).alias("s"), F.array_join(tokens, "").alias("w"), cuts.alias("cuts"))
    crossed = F.exists("cuts", lambda c: (c > F.col("s.a")) & (c < F.col("s.b")))
    typed = rows.select(F.col("w").substr(F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("type"), crossed.cast("int").alias("x"))
    return typed.groupBy("type").agg(F.sum(1 - F.col("x")).alias("right"), F.sum("x").alias("wrong"), F.avg("x").alias("ratio"))


def entropy_per_character(counts: dict[str, float], characters: float) -> float:
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values() if c) / (characters / total)


def transport(characters: dict[str, float], types: dict[str, float], reg: float = 0.05, rounds: int = 200) -> np.ndarray:
    """Sinkhorn: mass from characters to types, over the pairs in which the type has the character."""
    cs, ts = list(characters), list(types)
    cost = np.array([[1.0 / len(t) if c in t else 1e3 for t in ts] for c in cs])
    k = np.exp(-cost / reg / cost[cost < 1e3].max(initial=1.0))
    a = np.array([characters[c] for c in cs], float)
    b = np.array([types[t] * len(t) for t in ts], float)
    a, b, u = a / a.sum(), b / b.sum(), np.ones(len(cs))
    for _ in range(rounds):
        v = b / np.maximum(k.T @ u, 1e-300)
        u = a / np.maximum(k @ v, 1e-300)
    return u[:, None] * k * v[None, :]


def best_size(sizes: list[int], counts: dict[str, float], characters: float) -> int:
    """The size after which entropy per character falls least for each added type (the utility's largest step)."""
    top = sorted(counts, key=lambda t: (-counts[t], t))
    h = [entropy_per_character({t: counts[t] for t in top[:s]}, characters) for s in sizes]
    gains = [(h[i] - h[i + 1]) / (sizes[i + 1] - sizes[i]) for i in range(len(sizes) - 1)]
    return sizes[int(np.argmax(gains)) + 1] if gains else sizes[0]


def repeated_sentences(words: DataFrame, most_chars: int = 1000) -> DataFrame:
    """Words with counts as texts: each word as often as it counts, in texts of at most `most_chars` characters."""
    per = F.greatest(F.lit(1), F.floor(most_chars / (F.length("word") + 1))).cast("int")
    full, rest = F.floor(F.col("count") / per).cast("int"), (F.col("count") % per).cast("int")
    sizes = F.concat(F.array_repeat(per, full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    return words.select("word", F.explode(sizes).alias("k")).select(F.array_join(F.expr("array_repeat(word, k)"), " ").alias("text"))


def weighted_text(df: DataFrame, pretokens: Column, weight: str = "count") -> DataFrame:
    return df.select(F.array_join(pretokens, " ").alias("text"), weight)
