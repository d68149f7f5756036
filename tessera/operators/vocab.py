"""Vocabularies as tables: id assignment, look-ups, specials, offsets and hashed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import global_rank

#: A vocabulary up to this many types goes to every executor; a larger one is joined by shuffle.
BROADCAST_TYPES = 1_000_000


def _side(vocab: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(vocab) if size is not None and size <= BROADCAST_TYPES else vocab


def absolute_ids(types: DataFrame, taken: list[int], rank: str = "rank") -> DataFrame:
    """(type, id): types in order of rank fill the smallest ids that specials and UNK leave free; the first occurrence counts."""
    first = types.groupBy("type").agg(F.min(rank).alias(rank))
    ranked = global_rank(first, F.col(rank), F.col("type"), out="id")
    for t in sorted(set(taken)):  # every taken id at or below shifts the rest up by one
        ranked = ranked.withColumn("id", F.when(F.col("id") >= t, F.col("id") + 1).otherwise(F.col("id")))
    return ranked.select("type", F.col("id").cast("long").alias("id"))


def relative_ids(types: DataFrame, before: list[str], after: list[str], rank: str = "rank") -> tuple[DataFrame, DataFrame]:
    """((type, id), specials (name, id)): UNK is 0, then the specials in front, the types, and the specials behind."""
    n = types.select("type").distinct().count()
    spark = types.sparkSession
    specials = [(s, i + 1) for i, s in enumerate(before)] + [(s, len(before) + 1 + n + i) for i, s in enumerate(after)]
    return absolute_ids(types, list(range(len(before) + 1)), rank), spark.createDataFrame(specials, "name string, id long")


def compacted(vocab: DataFrame) -> DataFrame:
    return global_rank(vocab.select("type", F.col("id").alias("old")), F.col("old"), out="id").select("type", "id")


def to_ids(tokens: DataFrame, vocab: DataFrame, unk: int | None, token: str = "token", size: int | None = None) -> DataFrame:
    """tokens with id: the type's, else unk; without an unk an unknown token is an error."""
    joined = tokens.join(_side(vocab.select(F.col("type").alias(token), "id"), size), token, "left")
    missing = F.lit(unk) if unk is not None else F.raise_error(F.concat(F.lit("no id and no UNK for "), token))
    return joined.withColumn("id", F.coalesce("id", missing.cast("long")))


def from_ids(ids: DataFrame, vocab: DataFrame, specials: list[int], unk: int | None = None, size: int | None = None) -> DataFrame:
    """ids with token: '' for UNK and specials; any other unknown id is an error."""
    silent = F.col("id").isin(*specials, *([unk] if unk is not None else []))
    joined = ids.join(_side(vocab.select("id", F.col("type").alias("token")), size), "id", "left")
    return joined.withColumn("token", F.when(silent, F.lit("")).otherwise(F.coalesce("token", F.raise_error(F.concat(F.lit("no type for id "), F.col("id").cast("string"))))))


def without_baked(types: DataFrame, baked: list[str]) -> DataFrame:
    return types.where(~F.col("type").isin(*baked)) if baked else types


def combined(vocabs: list[DataFrame], sizes: list[int]) -> DataFrame:
    """One vocabulary of several, types prefixed by their number and ids moved past those before."""
    out, offset = None, 0
    for i, (v, n) in enumerate(zip(vocabs, sizes)):
        part = v.select(F.concat(F.lit(f"{i}_"), "type").alias("type"), (F.col("id") + offset).alias("id"))
        out, offset = part if out is None else out.unionByName(part), offset + n
    return out


def with_bytes(vocab: DataFrame, first: int) -> DataFrame:
    """vocab with a type for every byte value, from id `first` on."""
    extra = vocab.sparkSession.range(256).select(F.concat(F.lit("[BYTE "), F.col("id").cast("string"), F.lit("]")).alias("type"), (F.col("id") + first).alias("id"))
    return vocab.select("type", "id").unionByName(extra)


def hashed_id(token: Column, size: int, reserved: list[int] = ()) -> Column:
    """Without a table: the hash modulo what is free, moved past the reserved ids."""
    free = size - len(set(reserved))
    i = F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 10), 16, 10).cast("long"), F.lit(free))
    for t in sorted(set(reserved)):
        i = F.when(i >= t, i + 1).otherwise(i)
    return i


def word_level_unk(tokens: Column, known: Column) -> Column:
    """[''] if any token is unknown, else the tokens; null if there are none to know."""
    return F.when(F.forall(known, lambda x: x), tokens).when(known.isNotNull(), F.array(F.lit("")))


def template(ids: Column, before: list[int] = (), after: list[int] = (), pair: Column | None = None, between: list[int] = (), end: list[int] = ()) -> Column:
    """ids between special ids; with a pair, both of them and what stands between and behind."""
    lits = lambda xs: [F.array(*map(F.lit, xs)).cast("array<long>")] if xs else []
    if pair is None:
        return F.concat(*lits(before), ids.cast("array<long>"), *lits(after))
    return F.concat(*lits(before), ids.cast("array<long>"), *lits(between), pair.cast("array<long>"), *lits(end))


TEMPLATES = {
    "bert": (("CLS",), ("SEP",), ("SEP",), ("SEP",)),
    "roberta": (("BOS",), ("EOS",), ("EOS", "EOS"), ("EOS",)),
    "gpt": ((), ("EOS",), ("EOS",), ("EOS",)),
    "llama": (("BOS",), (), ("BOS",), ()),
    "modernbert": (("CLS",), ("SEP",), ("SEP",), ("SEP",)),
    "chatml": (("IM_START",), ("IM_END",), ("IM_END", "IM_START"), ("IM_END",)),
}


def named_template(name: str, ids: Column, specials: dict[str, int], pair: Column | None = None) -> Column:
    before, after, between, end = ([specials[s] for s in part] for part in TEMPLATES[name])
    return template(ids, before, after, pair, between, end)


def specials_mask(ids: Column, specials: list[int]) -> Column:
    return F.transform(ids, lambda x: x.isin(*specials).cast("int"))


def fewest(*candidates: Column) -> Column:
    """Of several tokenisations the one with the fewest tokens, the first on ties."""
    best = F.array_min(F.array(*(F.struct(F.size(c).alias("n"), F.lit(i).alias("i")) for i, c in enumerate(candidates))))
    return F.element_at(F.array(*candidates), best["i"] + 1)


def drawn(probabilities: list[float], key: Column, *candidates: Column, seed: int = 0) -> Column:
    """One of the candidates by a hash of the key: the draw doesn't depend on partitioning."""
    from tessera.operators.tokens import by_hash

    u = by_hash(key, seed)
    out, edge = candidates[-1], sum(probabilities[: len(candidates) - 1])
    for p, c in reversed(list(zip(probabilities, candidates[:-1]))):
        out = F.when(u < edge, c).otherwise(out)
        edge -= p
    return out


def boundary_marker(types: DataFrame, threshold: float = 0.5, most: int = 16) -> DataFrame:
    """(side, mark, share): the longest prefix and suffix that extend the commonest one, character by character, while at least
    `threshold` of the types have it. Counts of all prefixes are one grouped sum."""
    total = types.count()
    n = F.least(F.length("type"), F.lit(most))
    cut = lambda side: types.where("type <> ''").select(F.lit(side).alias("side"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("type", F.lit(1), i) if side == "start" else F.right(F.col("type"), i))).alias("mark"))
    counts = cut("start").unionByName(cut("end")).groupBy("side", "mark").agg((F.count("*") / total).alias("share")).where(F.col("share") >= threshold)
    return counts.groupBy("side").agg(F.max_by(F.struct("mark", "share"), F.length("mark")).alias("b")).select("side", "b.*")


def known(tokens: DataFrame, vocab: DataFrame, token: str = "token", infinite: bool = False) -> DataFrame:
    """tokens with known: is it a type? An infinite domain has every type."""
    if infinite:
        return tokens.withColumn("known", F.lit(True))
    marked = vocab.select(F.col("type").alias(token)).distinct().withColumn("__known", F.lit(True))
    return tokens.join(marked, token, "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def multiplexed(choice: Column, *candidates: Column) -> Column:
    """The candidate of that number."""
    out = candidates[-1]
    for i, c in enumerate(candidates[:-1]):
        out = F.when(choice == i, c).otherwise(out)
    return out


def succession(head, *tails):
    """A segmenter of a column, then segmenters of token lists, each given what the one before made."""
    def run(c: Column) -> Column:
        out = head(c)
        for t in tails:
            out = t(out)
        return out

    return run


def joined_in(n: int):
    """Token lists: every n neighbours become one."""
    def joined(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(n))
        # elements by their place, since a slice copies the list
        return F.when(F.size(t) == 0, t).when(t.isNotNull(), F.transform(starts, lambda i: F.concat_ws("", *(F.get(t, i + j) for j in range(n)))))

    # the list is a lambda's variable, so it's made once a row and not once a token
    return lambda tokens: F.get(F.transform(F.array(tokens), joined), F.lit(0))


def added(vocab: DataFrame, types: list[str]) -> DataFrame:
    """vocab with the types that it hasn't, on the ids after its last."""
    new = vocab.sparkSession.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(types))], "rank long, type string").join(vocab.select("type"), "type", "left_anti")
    top = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("top"))
    ranked = global_rank(new, F.col("rank"), out="id").crossJoin(F.broadcast(top))
    return vocab.select("type", "id").unionByName(ranked.select("type", (F.col("id") + F.col("top")).alias("id")))


def popped(vocab: DataFrame, types: list[str]) -> DataFrame:
    """vocab without the types; those after them move up."""
    return compacted(vocab.where(~F.col("type").isin(*types)))


def special_ranges(ids: DataFrame, column: str = "id") -> DataFrame:
    """(low, high) of the runs of neighbouring ids, inclusive."""
    i = global_rank(ids.select(F.col(column).alias("id")).distinct(), F.col("id"), out="__k")
    return i.groupBy(F.col("id") - F.col("__k")).agg(F.min("id").alias("low"), F.max("id").alias("high")).select("low", "high")


def repaired(types: int, specials: dict[str, int]) -> dict[str, int]:
    """Absolute ids for a vocabulary that turned out too small for them: what lies beyond the ids that are taken moves down."""
    out, end = {}, types
    for name, i in sorted(specials.items(), key=lambda x: x[1]):
        out[name] = min(i, end)
        end += 1
    return out


def split_flat(flat: DataFrame, specials: dict[str, str], unk: str | None = None) -> tuple[DataFrame, dict[str, int], int | None]:
    """(types, ids of the specials by name, id of UNK) of a flat vocabulary (type, id) with a string for every special.

    Ids must be 0, 1, 2, ... without gaps or repeats, and every string a type; UNK isn't a special."""
    if "UNK" in specials or unk in specials.values():
        raise ValueError("UNK doesn't count as a special")
    n, distinct, low, high = flat.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    if n != distinct or low != 0 or high != n - 1:
        raise ValueError("ids must be contiguous from 0")
    wanted = [*specials.values(), *([unk] if unk is not None else [])]
    found = {r["type"]: r["id"] for r in flat.where(F.col("type").isin(*wanted)).collect()} if wanted else {}
    if set(found) != set(wanted):
        raise ValueError(f"not in the vocabulary: {sorted(set(wanted) - set(found))}")
    types = flat.where(~F.col("type").isin(*wanted)) if wanted else flat
    return types, {name: found[s] for name, s in specials.items()}, found.get(unk)
