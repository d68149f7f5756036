"""Text mappers: string column to string column, all of them expressions that Catalyst can fold and fuse.

A mapper is a function Column -> Column. Reversible ones are `Mapper` pairs. Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.regexes import SPACE, java

Map = Callable[[Column], Column]


@dataclass(frozen=True)
class Mapper:
    """A reversible mapper."""

    convert: Map
    invert: Map

    def __call__(self, c: Column) -> Column:
        return self.convert(c)


class CharMapper(Mapper):
    """One that maps every character by itself, and U+0001 to itself on marked text."""

    def marked(self, c: Column) -> Column:
        return self.convert(c)


def compose(*maps: Map) -> Map:
    return lambda c: reduce(lambda x, m: m(x), maps, c)


def compose_invertible(*maps: Mapper) -> Mapper:
    return Mapper(compose(*maps), lambda c: reduce(lambda x, m: m.invert(x), reversed(maps), c))


identity = Mapper(lambda c: c, lambda c: c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, java(rf"\A{SPACE}+|{SPACE}+\z"), "")


def lower(c: Column) -> Column:
    return F.lower(c)


def truncate(n: int) -> Map:
    return lambda c: F.substring(c, 1, n)


def truncate_at_blank(limit: int, patience: int = 50, forwards: bool = False) -> Map:
    """Cut long texts at the blank nearest to the limit, looking back (or on) `patience` characters; else at the limit."""

    def run(c: Column) -> Column:
        low = limit - 1 if forwards else max(0, limit - 1 - patience)
        high = limit + patience if forwards else limit
        window = F.substring(c, low + 1, high - low)
        if forwards:
            at = F.locate(" ", window)
            cut = at + low - 1
        else:
            at = F.locate(" ", F.reverse(window))
            cut = F.length(window) - at + low
        return F.when(F.length(c) <= limit, c).when(at > 0, F.substring(c, F.lit(1), cut)).otherwise(F.substring(c, 1, limit))

    return run


def filter_regex(pattern: str, replacement: str = "") -> Map:
    return lambda c: F.regexp_replace(c, java(pattern), replacement)


def filter_characters(signs: str) -> Map:
    return lambda c: F.translate(c, signs, "")


def filter_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, java(SPACE), "")


#: Scheme, dotted host, and a tail that doesn't end in sentence punctuation. Without Unicode classes, RE2 reads it alike.
HYPERLINK = r"(?:https?|ftp)://[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]+)+[0-9A-Za-z_.,@?^=%&:/~+#-]*[0-9A-Za-z_@?^=%&/~+#-]"


def filter_hyperlinks(c: Column) -> Column:
    return F.regexp_replace(c, HYPERLINK, "")


def swallow_if_contains(pattern: str) -> Map:
    return lambda c: F.when(c.rlike(java(pattern)), F.lit("")).otherwise(c)


def limit_repetitions(n: int) -> Map:
    return lambda c: F.regexp_replace(c, rf"(?s)(.)\1{{{n},}}", "$1" * n)


def dilate(split: Map) -> Map:
    return lambda c: F.array_join(split(c), " ")


def append_space(front: bool = True) -> Mapper:
    if front:
        return Mapper(lambda c: F.concat(F.lit(" "), c), lambda c: F.regexp_replace(c, java(rf"\A{SPACE}"), ""))
    return Mapper(lambda c: F.concat(c, F.lit(" ")), lambda c: F.regexp_replace(c, java(rf"{SPACE}\z"), ""))


def replace(old: str, new: str) -> Mapper:
    if not old or not new:
        raise ValueError("neither side may be empty")
    return (CharMapper if len(old) == 1 else Mapper)(lambda c: F.replace(c, F.lit(old), F.lit(new)), lambda c: F.replace(c, F.lit(new), F.lit(old)))


class Side(Enum):
    ISOLATED = 0
    START = 1
    END = 2


@dataclass(frozen=True)
class Marker:
    """A mark at the start or the end of a word, or a token beside it."""

    substitute: str
    detached: bool = True
    side: Side = Side.START

    def isolate(self, c: Column) -> Column:
        """struct(root, mark): the word without its mark; mark is empty if it had none."""
        n, m = len(self.substitute), F.lit(self.substitute)
        none = F.struct(c.alias("root"), F.lit("").alias("mark"))
        if not n:
            return none
        if self.side == Side.ISOLATED:
            return F.when(c == m, F.struct(F.lit("").alias("root"), m.alias("mark"))).otherwise(none)
        if self.side == Side.START:
            return F.when(c.startswith(m), F.struct(F.substring(c, F.lit(n + 1), F.length(c)).alias("root"), m.alias("mark"))).otherwise(none)
        return F.when(c.endswith(m), F.struct(F.substring(c, F.lit(1), F.length(c) - n).alias("root"), m.alias("mark"))).otherwise(none)

    def concatenate(self, root: Column, mark: Column) -> Column:
        return F.concat(root, mark) if self.side == Side.END else F.concat(mark, root)

    def atomise(self, c: Column) -> Column:
        """Characters of the word, with the mark a token of its own (detached) or on the edge's character."""
        parts = self.isolate(c)
        atoms = F.filter(F.split(parts["root"], ""), lambda x: x != "")
        mark = F.filter(F.array(parts["mark"]), lambda x: x != "")
        if self.detached:
            return F.concat(atoms, mark) if self.side == Side.END else F.concat(mark, atoms)
        n = F.size(atoms)
        if self.side == Side.END:
            glued = F.transform(atoms, lambda x, i: F.when(i == n - 1, F.concat(x, parts["mark"])).otherwise(x))
        else:
            glued = F.transform(atoms, lambda x, i: F.when(i == 0, F.concat(parts["mark"], x)).otherwise(x))
        return F.when(n == 0, mark).otherwise(glued)


SENNRICH, ISOLATED = Marker("</w>", False, Side.END), Marker("[SPACE]", True, Side.ISOLATED)
KUDO, ROBERTA, LITTLE_ENDIAN = Marker("▁", False, Side.START), Marker("Ġ", False, Side.START), Marker("Ġ", False, Side.END)
NO_SPACE, PREFIX_SPACE, SUFFIX_SPACE = Marker("", False, Side.START), Marker(" ", False, Side.START), Marker(" ", False, Side.END)


def replace_boundary(old: str, marker: Marker) -> Mapper:
    source = Marker(old, marker.detached, marker.side)

    def between(a: Marker, b: Marker) -> Map:
        def run(c: Column) -> Column:
            parts = a.isolate(c)
            return F.when(parts["mark"] != "", b.concatenate(parts["root"], F.lit(b.substitute))).otherwise(c)

        return run

    return Mapper(between(source, marker), between(marker, source))


def turkish_capitals(c: Column) -> Column:
    return F.translate(c, "çıöüşğ", "CIOUSG")


@cache
def _stable(form: str) -> str:
    """A class of characters that the form leaves alone, each by itself and beside any other of them: of Latin, Greek and Cyrillic
    letters and common punctuation, those that are no combining marks and stand for themselves."""
    import unicodedata

    spans, codes = [], [*range(0x250), *range(0x370, 0x530), *range(0x2010, 0x2028), 0x20AC]
    for c in codes:
        if not unicodedata.combining(chr(c)) and unicodedata.normalize(form, chr(c)) == chr(c):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)


def normalise(form: str = "NFKC") -> Map:
    """Unicode normalisation; rows of characters that it can't change never leave the JVM."""
    def run(texts: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return lambda c: F.when(c.rlike(rf"\A(?:[\x00-\x7f]++|[{_stable(form)}]++)*+\z"), c).otherwise(F.arrow_udf(run, "string")(c))


def truncate_and_normalise(n: int) -> Map:
    return compose(truncate_at_blank(n), normalise())


def alphabet(kind: str) -> list[str]:
    """Characters that a registered alphabet makes mandatory; the text itself passes unchanged."""
    spans = {"ascii": [(32, 127)], "greek": [(0x391, 0x3A2), (0x3A3, 0x3AA), (0x3B1, 0x3CA)], "cyrillic": [(0x410, 0x450), (0x401, 0x402), (0x451, 0x452)]}
    return [chr(i) for a, b in spans[kind] for i in range(a, b)]
