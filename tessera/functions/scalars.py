"""Scalar functions on strings, numbers and arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shash(c: Column, bits: int = 40) -> Column:
    """The first bits of the SHA-256, in hex."""
    return F.substring(F.sha2(c, 256), 1, bits // 4)


def prefix_if(c: Column, prefix: str) -> Column:
    return F.when(F.length(c) > 0, F.concat(F.lit(prefix), c)).otherwise(c)


def suffix_if(c: Column, suffix: str) -> Column:
    return F.when(F.length(c) > 0, F.concat(c, F.lit(suffix))).otherwise(c)


def circumfix_if(c: Column, prefix: str, suffix: str) -> Column:
    return F.when(F.length(c) > 0, F.concat(F.lit(prefix), c, F.lit(suffix))).otherwise(c)


def interfix_if(a: Column, between: str, b: Column) -> Column:
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.concat(a, F.lit(between), b)).otherwise(F.concat(a, b))


def words_of_case(c: Column) -> Column:
    """Small words of a name in any of the usual cases."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"([\p{Ll}\p{N}])(?=\p{Lu})", "$1 ")), r"[\s_\-]+"), lambda x: x != "")


def convert_case(c: Column, case: str) -> Column:
    """To snake, kebab, pascal, camel, flat or spaced."""
    w = words_of_case(c)
    if case in ("snake", "kebab", "flat", "spaced"):
        return F.array_join(w, {"snake": "_", "kebab": "-", "flat": "", "spaced": " "}[case])
    return F.array_join(F.transform(w, lambda x, i: F.when(F.lit(case == "camel") & (i == 0), x).otherwise(F.initcap(x))), "")


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(acc))
    return same


def token_lengths(tokens: Column) -> Column:
    return F.transform(tokens, F.length)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value made once a row, however often f's lambdas look at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _places(signs: Column, sign: str) -> Column:
    """Where a sign stands in a string, from 0, in one walk."""
    return F.filter(F.transform(F.split(signs, ""), lambda c, i: F.when(c == sign, i)), lambda i: i.isNotNull())


def token_starts(tokens: Column) -> Column:
    """Offset of each token: 0, then running sums."""
    # a sign a character and one at each token's end: the k-th end stands behind k other ends
    ends = lambda t: _places(F.array_join(F.transform(t, lambda x: F.concat(F.repeat(F.lit("0"), F.coalesce(F.length(x), F.lit(0))), F.lit("|"))), ""), "|")
    return bound(tokens, lambda t: bound(ends(t), lambda e: F.transform(t, lambda x, i: F.when(i == 0, 0).otherwise(F.get(e, i - 1) - (i - 1)))))


def token_mask(tokens: Column) -> Column:
    """As a string of bits: a 1 at every inner position where a token begins."""
    bits = F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(t) - 1))), "")
    return F.substring(bits, F.lit(2), F.length(bits))


def split_positions(tokens: Column) -> Column:
    return F.filter(token_starts(tokens), lambda i: i > 0)


def cut_at(text: Column, starts: Column) -> Column:
    """Tokens of a text from the offsets at which they start (the first is 0)."""
    return bound(starts, lambda at: F.transform(at, lambda s, i: text.substr(s + 1, F.coalesce(F.get(at, i + 1), F.length(text)) - s)))


def from_mask(text: Column, mask: Column) -> Column:
    inner = F.transform(_places(F.substring(F.coalesce(mask, F.lit("")), F.lit(1), F.length(text) - 1), "1"), lambda i: i + 1)
    starts = F.concat(F.array(F.lit(0)), inner)
    return F.when(F.length(text) > 0, cut_at(text, starts)).otherwise(F.array().cast("array<string>"))


def bit_key(lengths: Column) -> Column:
    """Number of a segmentation up to 63 positions: its mask read as binary, most significant first."""
    bits = F.array_join(F.transform(lengths, lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n - 1))), "")
    return F.conv(F.concat(F.lit("0"), F.substring(bits, F.lit(2), F.length(bits))), 2, 10).cast("long")


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))


def ln_then_softmax(a: Column, temperature: float = 1.0) -> Column:
    return softmax(F.transform(a, F.log), temperature)


def power_normalised(a: Column, temperature: float = 1.0) -> Column:
    return normalised(F.transform(a, lambda x: F.pow(x, F.lit(1 / temperature))))


#: Transforms of a boundary probability; a value for not cutting comes from 1 - p.
PROBABILITY = {
    "identity": lambda p: p,
    "log": lambda p: F.log(p),
    "linear": lambda p, a=-1.0, b=1.0: a + p * (b - a),
    "piecewise": lambda p, a=-1.0, b=1.0: F.when(p < 0.5, a * (1 - 2 * p)).otherwise(b * (2 * p - 1)),
    "power": lambda p, c=0.25: F.pow(p, F.lit(c)),
    "sine": lambda p: F.sin(p * F.lit(3.141592653589793 / 2)),
    "exponential": lambda p, c=1.0: (F.exp(c * p) - 1) / (F.exp(F.lit(c)) - 1),
    "doubling": lambda p: F.pow(F.lit(2.0), p) - 1,
}


def schedule(kind: str, t: Column, start: float, end: float, c: float = 2.0) -> Column:
    """From start to end as t goes from 0 to 1, with time dilated."""
    d = {"identity": t, "power": F.pow(t, F.lit(c)), "exponential": (F.pow(F.lit(c), t) - 1) / (c - 1), "log": F.log(1 + t * (c - 1)) / F.log(F.lit(c))}[kind]
    return start + (end - start) * d


def index_span(a: Column, span: Column) -> Column:
    """First index at which span occurs in a; null if nowhere."""
    n = F.size(a) - F.size(span)
    return F.when(n >= 0, F.get(F.filter(F.sequence(F.lit(0), n), lambda i: F.slice(a, i + 1, F.size(span)) == span), F.lit(0)))


def invert_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def with_alias(m: Column, old: str, new: str) -> Column:
    return F.map_concat(m, F.map_from_arrays(F.array(F.lit(new)), F.array(F.element_at(m, old))))


def substitute_key(m: Column, old: str, new: str) -> Column:
    return F.map_filter(with_alias(m, old, new), lambda k, v: k != old)


def stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd_HH-mm-ss")


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    from collections import Counter

    out = []
    for k in range(0, len(a), 256):  # few rows' lists at a time
        for x, y in zip(a.slice(k, 256).to_pylist(), b.slice(k, 256).to_pylist()):
            if x is None or y is None:
                out.append(1.0)
                continue
            x, y = Counter(z for z in x if z is not None), Counter(z for z in y if z is not None)
            low = sum((x & y).values())
            high = x.total() + y.total() - low
            out.append(low / high if high else 1.0)
    return pa.array(out, pa.float64())


def jaccard(a: Column, b: Column) -> Column:
    """Of multisets: shared over united multiplicities. Each element is looked at once."""
    return F.arrow_udf(_jaccard, "double")(a, b)


# Combinatorics of compositions, in Python integers (results may exceed 64 bits).


def compositions(n: int, k: int | None = None):
    """Tuples of positive integers that sum to n (k of them)."""
    if k is None:
        for k in range(1, n + 1):
            yield from compositions(n, k)
    elif k == 1:
        yield (n,)
    else:
        for first in range(1, n - k + 2):
            for rest in compositions(n - first, k - 1):
                yield (first, *rest)


def partitions(n: int, k: int, least: int = 1):
    """Ascending tuples of k positive integers that sum to n."""
    if k == 1:
        if n >= least:
            yield (n,)
        return
    for first in range(least, n // k + 1):
        for rest in partitions(n - first, k - 1, first):
            yield (first, *rest)


def multiset_permutations(items) -> int:
    counts = {x: list(items).count(x) for x in items}
    return reduce(lambda a, c: a // factorial(c), counts.values(), factorial(len(items)))


def permutation_rank(items) -> int:
    """Place of the sequence among all orders of its multiset, smallest first."""
    items, rank = list(items), 0
    while items:
        for x in sorted(set(items)):
            if x == items[0]:
                break
            rest = list(items)
            rest.remove(x)
            rank += multiset_permutations(rest)
        items = items[1:]
    return rank


def loc_key(lengths) -> int:
    """Length-ordered number of a composition: by how many parts, then by ascending partition, then by order of the parts."""
    n, k = sum(lengths), len(lengths)
    if not n:
        return 0
    key = sum(comb(n - 1, j - 1) for j in range(1, k))
    for p in partitions(n, k):
        if p == tuple(sorted(lengths)):
            return key + permutation_rank(lengths)
        key += multiset_permutations(p)
    raise AssertionError("no such partition")


def framed(c: Column, sign: str = "#", width: int = 1) -> Column:
    """A text with a frame of signs around its lines."""
    lines = F.split(c, "\n")
    n = F.array_max(F.transform(lines, F.length))
    edge, side = F.repeat(F.lit(sign), n + (2 + 2 * width)), F.lit(sign * width)
    inside = F.transform(lines, lambda x: F.concat(side, F.lit(" "), F.concat(x, F.repeat(F.lit(" "), n - F.length(x))), F.lit(" "), side))
    return F.concat_ws("\n", edge, F.array_join(inside, "\n"), edge)


def indented(c: Column, level: int, tab: str = "    ") -> Column:
    """Every line after so many tabs; an empty last line stays empty."""
    return F.concat(F.lit(tab * level), F.regexp_replace(c, r"\n(?!\z)", "\n" + tab * level))


def aligned(c: Column, sign: str) -> Column:
    """Blanks before the first such sign of each line, so that they stand in one column."""
    lines = F.split(c, "\n")
    top = F.array_max(F.transform(lines, lambda x: F.locate(sign, x)))
    moved = F.transform(lines, lambda x: F.when(F.locate(sign, x) == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), F.locate(sign, x) - 1), F.repeat(F.lit(" "), top - F.locate(sign, x)), F.substring(x, F.locate(sign, x), F.length(x)))))
    return F.array_join(moved, "\n")


def separated_thousands(c: Column, sep: str = " ") -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(sep))


def percent(a: Column, b: Column, decimals: int = 2) -> Column:
    return F.when(b == 0, F.lit("???%")).otherwise(F.concat(F.round(100 * a / b, decimals).cast("string"), F.lit("%")))


def ordinal(c: Column) -> Column:
    return F.concat(c.cast("string"), F.when(c == 1, "st").when(c == 2, "nd").when(c == 3, "rd").otherwise("th"))


def pluralised(c: Column, singular: str, suffix: str = "s", plural: str = "") -> Column:
    return F.concat(c.cast("string"), F.lit(" "), F.when(c == 1, singular).otherwise(plural or singular + suffix))


def signed(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), c.cast("string"))


def compared(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.when(a == b, " = ").when(a > b, " > ").otherwise(" < "), b.cast("string"))


def human(c: Column, digits: int = 2, base: int = 1000) -> Column:
    """A number with a letter for its magnitude; rounded at each step, trailing zeros cut."""
    signs = ["", *(x + ("i" if base == 1024 else "") for x in ("K", "M", "G", "T", "P", "E", "Z", "Y"))]
    value, out, steps = c.cast("double"), None, []
    for _ in signs:
        steps.append(value)
        value = F.round(value / base, digits)
    shown = lambda x, s: F.concat(F.regexp_replace(F.regexp_replace(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")), "0+$", ""), "\\.$", ""), F.lit(s))
    for x, s in reversed(list(zip(steps, signs))):
        out = shown(x, s) if out is None else F.when(F.abs(x) < base, shown(x, s)).otherwise(out)
    return out


def struct_to_map(c: Column, fields: list[str]) -> Column:
    """name → value (as text) of the fields that aren't null."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(c[f].cast("string") for f in fields))), lambda k, v: v.isNotNull())


def at_path(c: Column, path: str) -> Column:
    for part in path.split("."):
        c = c.getField(part)
    return c


def with_path(c: Column, path: str, value: Column) -> Column:
    return c.withField(path, value)


def pipe(*steps):
    """One after the other, left to right."""
    def run(x):
        for s in steps:
            x = s(x)
        return x

    return run


def disambiguated(df: DataFrame, column: str, order: str, out: str = "name") -> DataFrame:
    """df with a unique name per row: the text, with _2, _3, ... from its second row in order on. A name that another row has already is
    numbered again, until all differ."""
    from pyspark.sql.window import Window

    from tessera.sources.artifacts import checkpoint

    rows = df.withColumn(out, F.col(column))
    while True:
        k = F.row_number().over(Window.partitionBy(out).orderBy(order))
        rows = checkpoint(rows.withColumn("__k", k).withColumn(out, F.when(F.col("__k") > 1, F.concat(F.col(out), F.lit("_"), F.col("__k").cast("string"))).otherwise(F.col(out))))
        if not rows.where("__k > 1").limit(1).count():
            return rows.drop("__k")
