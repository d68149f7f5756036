"""Segmentations held against morphs: integrity, dilution, alignment, and tag alignment by EM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import bound, token_starts
from tessera.operators.aggregates import nested_micro_macro


def spans(tokens: Column) -> Column:
    return bound(tokens, lambda ts: bound(token_starts(ts), lambda at: F.transform(ts, lambda t, i: F.struct(F.get(at, i).alias("a"), (F.get(at, i) + F.length(t)).alias("b")))))


def _intervals(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of the lists: row, number in the row, offset in the row, length."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    length = np.asarray(pc.fill_null(pc.utf8_length(lists.flatten()), 0), np.int64)
    row, first = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    before = np.concatenate([[0], np.cumsum(length)])
    return row, np.arange(len(row)) - first[row], before[:-1] - before[first[row]], length


def _overlaps(tokens: pa.Array, morphs: pa.Array) -> pa.Array:
    """Per row, in order, what lies between neighbouring edges of a token or a morph, where there are both. Rows lie behind each other on one line."""
    sides, rows = [_intervals(tokens), _intervals(morphs)], len(tokens)
    far = np.zeros(rows, np.int64)
    for row, _, at, length in sides:
        np.maximum.at(far, row, at + length)
    base = np.cumsum(far) - far
    edges = np.unique(np.concatenate([x for row, _, at, length in sides for x in (base[row] + at, base[row] + at + length)]))
    left, size, there, found = edges[:-1], np.diff(edges), np.ones(max(len(edges) - 1, 0), bool), []
    for row, number, at, length in sides:
        full = np.flatnonzero(length)
        if not len(full):
            return pa.array([[]] * rows, OVERLAPS)
        starts = (base[row] + at)[full]
        k = np.searchsorted(starts, left, "right") - 1
        there &= (k >= 0) & (starts[k] + length[full[k]] > left)
        found.append(full[k])
    (t, m), best = (f[there] for f in found), size[there]
    (_, piece, _, tlen), (row, morph, _, length) = sides
    parts = [pa.array(x.astype(np.int32)) for x in (morph[m], length[m], best, piece[t], tlen[t])]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[m], minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(OVERLAPS.value_type)))


OVERLAPS = pa.list_(pa.struct([(n, pa.int32()) for n in ("morph", "length", "best", "piece", "tlen")]))


def overlaps(df: DataFrame, tokens: str, morphs: str, key: str) -> DataFrame:
    """(key, morph, length, best, piece, tlen): every morph with each token (its number: piece) that overlaps it, and by how much (best)."""

    @F.arrow_udf("array<struct<morph: int, length: int, best: int, piece: int, tlen: int>>")
    def run(t: pa.Array, m: pa.Array) -> pa.Array:
        return _overlaps(t, m)

    return df.select(key, F.inline(run(F.col(tokens), F.col(morphs))))


def integrity(df: DataFrame, tokens: str, morphs: str, key: str) -> DataFrame:
    """Largest share of each morph that lies in one token, averaged in four ways over morphs and words."""
    best = overlaps(df, tokens, morphs, key).groupBy(key, "morph").agg(F.max("best").alias("n"), F.max("length").alias("d"))
    return nested_micro_macro(best, key, "n", "d")


def dilution(df: DataFrame, tokens: str, morphs: str, key: str) -> DataFrame:
    """(key, tokens, morphs, contaminated, diluted): a token is contaminated if it has characters of several morphs and misses
    some of one of them; a morph is diluted if a contaminated token has characters of it but not all."""
    o = overlaps(df, tokens, morphs, key)
    part = F.struct("morph", (F.col("best") < F.col("length")).alias("part"))
    per_token = o.groupBy(key, "piece").agg(F.collect_list(part).alias("ms"))
    bad = (F.size("ms") > 1) & F.exists("ms", lambda m: m["part"])
    # both counts are distinct ones of what lies in a key: its tokens once each, its morphs with whether one of their parts is in a bad token
    morphs = F.transform("ms", lambda m: F.struct(m["morph"].alias("morph"), (F.col("bad") & m["part"]).alias("diluted")))
    rows = per_token.withColumn("bad", bad).select(key, "bad", F.posexplode(morphs).alias("i", "m"))
    per_morph = rows.groupBy(key, "m.morph").agg(
        F.max(F.col("m.diluted").cast("int")).alias("diluted"), F.sum(F.when(F.col("i") == 0, 1)).alias("tokens"), F.sum(F.when((F.col("i") == 0) & F.col("bad"), 1)).alias("contaminated"),
    )
    sums = per_morph.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("morphs"), F.coalesce(F.sum("contaminated"), F.lit(0)).alias("contaminated"), F.sum("diluted").cast("long").alias("diluted"))
    return sums.select(key, "tokens", "morphs", "contaminated", "diluted")


def alignment_score(df: DataFrame, tokens: str, morphs: str, key: str, adversarial: bool = False) -> DataFrame:
    """(key, score, n): per inner morph boundary, its nearest (farthest) cut within half a morph on either side, as 1 - d / (1 + half)."""
    ms, cuts = spans(F.col(morphs)), F.filter(token_starts(F.col(tokens)), lambda i: i > 0)
    rows = df.select(key, F.posexplode(ms).alias("i", "m"), ms.alias("ms"), cuts.alias("cuts")).where("i > 0")
    left = F.get("ms", F.col("i") - 1)
    before, after = F.floor((left["b"] - left["a"]) / 2), F.floor((F.col("m.b") - F.col("m.a")) / 2)
    near = F.filter("cuts", lambda c: (c >= F.col("m.a") - before) & (c <= F.col("m.a") + after))
    score = F.transform(near, lambda c: 1 - F.abs(c - F.col("m.a")) / (1 + F.when(c < F.col("m.a"), before).otherwise(after)))
    best = F.coalesce(F.array_min(score) if adversarial else F.array_max(score), F.lit(0.0))
    return rows.groupBy(key).agg(F.sum(best).alias("score"), F.count("*").alias("n"))


def alignment_em(df: DataFrame, tokens: str, tags: str, iterations: int = 5) -> DataFrame:
    """(tag, token, p): IBM model 1 from tags to tokens, uniform start. Two grouped sums an iteration; each is checkpointed."""
    from tessera.sources.artifacts import checkpoint

    pairs = checkpoint(df.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(tags).alias("tag"), tokens).select("row", "tag", F.explode(tokens).alias("token")))
    t = pairs.select("tag", "token").distinct().withColumn("p", F.lit(1.0))
    for _ in range(iterations):
        scored = pairs.join(t, ["tag", "token"])
        norm = scored.groupBy("row", "token").agg(F.sum("p").alias("z"))
        share = scored.join(norm, ["row", "token"]).groupBy("tag", "token").agg(F.sum(F.col("p") / (F.col("z") + 1e-10)).alias("c"))
        total = share.groupBy("tag").agg(F.sum("c").alias("s"))
        t = checkpoint(share.join(total, "tag").select("tag", "token", (F.col("c") / F.col("s")).alias("p")))
    return t
