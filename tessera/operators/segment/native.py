"""Segmenters that need no Python: fixed chunks, characters, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(n: int):
    """Chunks of n characters; the last may be shorter."""
    return lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), 0)


def strided_ngrams(n: int, stride: int):
    """Overlapping chunks of n every `stride` characters: max(0, ceil((length - n) / stride)) + 1 of them."""

    def run(c: Column) -> Column:
        # one walk over the text: what follows every `stride` characters; a substring by its number would count from the start each time
        k = F.greatest(F.lit(0), F.ceil((F.length(c) - n) / stride)).cast("int") + 1
        chunks = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{1,{n}}})).{{1,{stride}}}"), 1)
        return F.get(F.transform(F.array(chunks), lambda x: F.concat(F.slice(x, F.lit(1), k), F.array_repeat(F.lit(""), F.greatest(k - F.size(x), F.lit(0))))), F.lit(0))

    return run


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def code_points(c: Column) -> Column:
    return F.transform(characters(c), lambda x: F.conv(F.hex(F.encode(x, "utf-32")), 16, 10).cast("long"))


def whole(c: Column) -> Column:
    return F.array(c)


def looked_up(df: DataFrame, table: DataFrame, pretoken: str = "pretoken", unk: bool = True) -> DataFrame:
    """df with tokens from a table (pretoken, tokens); unknown ones give [''] if there is an UNK, else themselves."""
    joined = df.join(table.select(pretoken, "tokens"), pretoken, "left")
    return joined.withColumn("tokens", F.coalesce("tokens", F.array(F.lit("")) if unk else F.array(pretoken)))
