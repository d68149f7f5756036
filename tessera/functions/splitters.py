"""Pretokenisers: string column to array<string> column, and the inverses that can be stated.

Splitters that keep what they split on enclose every match in a control character and split there (`isolate`), which
needs one pass of the JVM's engine with look-around. Null gives null; empty pieces are dropped.

A splitter that only sets such marks also has `marked`, which does so on a text that already holds some: a sequence of these
runs over the whole text, one expression of generated code after the other, and splits once, instead of a lambda per piece.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import punctuation

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.regexes import SPACE, char_class, java
from tessera.functions.text import Marker, Side

Split = Callable[[Column], Column]
CUT = "\x01"


def marking(split: Split, marked: Callable[[Column], Column]) -> Split:
    """split, with its form on marked text: what it cuts is enclosed in CUT, and CUT is an edge to it."""

    def run(c: Column) -> Column:
        return split(c)

    run.marked = marked
    return run


def sequence(*splits: Split) -> Split:
    """Flat map of each splitter over the pieces of the one before. Where the first two or more of them can mark, they do, over the
    whole text; the control character U+0001 of the text itself is dropped then."""
    lead = next((i for i, s in enumerate(splits) if not hasattr(s, "marked")), len(splits))

    def run(c: Column) -> Column:
        if lead > 1:
            text = reduce(lambda x, s: s.marked(x), splits[:lead], F.replace(c, F.lit(CUT), F.lit("")))
            out = _full(F.split(text, CUT + "+"))
        else:
            out = F.array(c)
        for s in splits[lead if lead > 1 else 0 :]:
            out = F.flatten(F.transform(out, s))
        return F.when(c.isNotNull(), out)

    return run


def nested(*splits: Split) -> Split:
    """The sequence by its definition, piece by piece."""

    def run(c: Column) -> Column:
        return F.when(c.isNotNull(), reduce(lambda x, s: F.flatten(F.transform(x, s)), splits, F.array(c)))

    return run


def stages(*splits: Split) -> list[Split]:
    """The sequence after each of its steps, for a diagnostic view."""
    return [nested(*splits[: i + 1]) for i in range(len(splits))]


def unsplit(c: Column) -> Column:
    return F.array_join(c, "")


def _full(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def _mark(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, java(f"({pattern})"), f"{CUT}$1{CUT}")


def isolate(pattern: str, inside: str | None = None) -> Split:
    """Matches and what lies between, in order; the control character U+0001 of the text itself is dropped.

    inside: the pattern on marked text, where CUT is an edge. Without one, the splitter can't mark."""
    split = lambda c: _full(F.split(_mark(pattern)(F.replace(c, F.lit(CUT), F.lit(""))), CUT))
    return split if inside is None else marking(split, _mark(inside))


def whole(c: Column) -> Column:
    return F.array(c)


def on_regex(pattern: str, destructive: bool = True) -> Split:
    return (lambda c: _full(F.split(c, java(pattern)))) if destructive else isolate(pattern)


def into_regex_groups(pattern: str, group: int = 0) -> Split:
    return lambda c: F.regexp_extract_all(c, F.lit(java(pattern)), group)


BLANK = r"[\s\x1C-\x1F​]"


def on_whitespace(destructive: bool = True) -> Split:
    if not destructive:
        return isolate(BLANK + "+", BLANK + "+")
    return marking(on_regex(BLANK + "+"), lambda c: F.regexp_replace(c, java(BLANK + "+"), CUT))


def into_space_prefixed(prefix: bool = True) -> Split:
    """Every white space sticks to what follows it (or to what it follows)."""
    other = BLANK.replace("[", "[^")
    return into_regex_groups(rf"{BLANK}{other}*|{other}+" if prefix else rf"{other}*{BLANK}|{other}+")


def on_whitespace_marked(marker: Marker) -> Split:
    """Split on white space; a piece that had some before it (after it, for a mark at the end) gets the mark."""
    def run(c: Column) -> Column:
        mark = F.lit(marker.substitute)
        words = on_whitespace()(c)
        n = F.size(words)
        if marker.side == Side.END:
            head = F.transform(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda w: F.concat(w, mark))
            tail = F.slice(words, F.greatest(n, F.lit(1)), F.lit(1))
            return F.concat(head, F.when(c.rlike(java(BLANK + r"\z")), F.transform(tail, lambda w: F.concat(w, mark))).otherwise(tail))
        first = c.rlike(java(r"\A" + BLANK))
        if marker.side == Side.START:
            return F.transform(words, lambda w, i: F.when((i > 0) | first, F.concat(mark, w)).otherwise(w))
        marked = F.flatten(F.transform(words, lambda w, i: F.when((i > 0) | first, F.array(mark, w)).otherwise(F.array(w))))
        return F.when((n == 0) & first, F.array(mark)).otherwise(marked)

    return run


HYPHENS = "-–_"


def punctuation_signs(hyphens: str) -> str:
    """hyphens: only, excluded or included."""
    if hyphens == "only":
        return HYPHENS
    rest = "".join(c for c in punctuation + "€£…‘’“”„«»" if c not in HYPHENS)
    return rest if hyphens == "excluded" else HYPHENS + rest


def isolate_punctuation(hyphens: str = "included", protect_apostrophes: bool = True, group_spaces: Side | None = None) -> Split:
    """Runs of punctuation apart from words; apostrophes inside words may stay, and a blank beside a run may join it."""
    p, q = char_class(punctuation_signs(hyphens)), char_class(punctuation_signs(hyphens).replace("'", ""))
    start, end = (SPACE + "?" if group_spaces == s else "" for s in (Side.START, Side.END))
    if hyphens == "only":
        return isolate(p + "+", p + "+")
    if not protect_apostrophes:
        return isolate(f"{start}{p}+{end}", f"{start}{p}+{end}")

    def pattern(first: str, last: str) -> str:
        opening = f"(?:{SPACE}|{first})'" if group_spaces == Side.START else f"(?:(?<={SPACE})|{first})'"
        closing = f"'(?:{SPACE}|{last})" if group_spaces == Side.END else f"'(?={SPACE}|{last})"
        guard = f"(?=[{SPACE[1:-1]}]|{p})" if start else f"(?={p})"  # most characters can't begin a match: one look tells
        return f"{guard}(?:{start}{p}*{q}+{p}*{end}|{opening}|{closing})"

    return isolate(pattern(r"\A", r"\z"), pattern(rf"\A|(?<={CUT})", rf"\z|(?={CUT})"))


def group_distinct_punctuation(c: Column) -> Column:
    """A piece that is punctuation alone (after a blank at most) falls into runs of equal signs."""
    p = char_class(punctuation_signs("included"))
    return F.when(c.rlike(java(rf"\A\s?{p}+\z")), F.regexp_extract_all(c, F.lit(r"(?s)((.)\2*)"), 1)).otherwise(F.array(c))


isolate_numbers = isolate(_numbers := r"(?:\p{N}|[.,](?=\p{N}))+", _numbers)
isolate_digits = isolate(r"\p{N}", r"\p{N}")
_beside = SPACE.replace("[", "[^")
isolate_connecting_hyphens = isolate(rf"(?<!-)(?<={_beside})-+(?={_beside})(?!-)", rf"(?<!-)(?<={_beside})(?<!{CUT})-+(?={_beside})(?!-|{CUT})")


def join_connecting_hyphens(c: Column) -> Column:
    """Inverse of isolate_connecting_hyphens: hyphens go back between their neighbours."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x.rlike(r"\A-+\z") | F.element_at(acc, -1).rlike(r"[^-]-+\z")),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(c, F.array().cast("array<string>"), step)


def group_digits(n: int = 3) -> Split:
    """Digit runs apart from the rest, in groups of at most n from the right."""
    mark = lambda c: F.regexp_replace(_mark(r"\d+")(c), java(rf"(?<=\d)(?=(?:\d{{{n}}})+(?!\d))"), CUT)
    return marking(lambda c: _full(F.split(mark(F.replace(c, F.lit(CUT), F.lit(""))), CUT)), mark)


def polarise_apostrophes(left_on_ties: bool = True) -> Split:
    """Each apostrophe goes to its shorter neighbour, to one that has characters, and never to another apostrophe."""

    def run(c: Column) -> Column:
        parts = F.split(c, "'")
        size = F.size(parts)
        here = lambda i: F.length(F.get(parts, i))
        tie = here
        to_left = lambda i: (here(i + 1) == 0) | (
            (here(i) != 0) & ((here(i) < here(i + 1)) | ((tie(i) == tie(i + 1)) if left_on_ties else F.lit(False)))
        )
        # lengths are those of the bare pieces: an apostrophe that was given away doesn't count
        glue = lambda x, i: F.concat(
            F.when((i > 0) & ~to_left(i - 1), F.lit("'")).otherwise(F.lit("")), x, F.when((i < size - 1) & to_left(i), F.lit("'")).otherwise(F.lit(""))
        )
        return _full(F.transform(parts, glue))

    return run


def isolate_contractions(nt: bool = True) -> Split:
    pattern = lambda last: rf"(?i)(?:'(?:s|re|ve|m|ll|d){'|n' + chr(39) + 't|' + chr(39) + 't' if nt else '|' + chr(39) + 't'})(?={SPACE}|{last}|\p{{P}})"
    return isolate(pattern(r"\z"), pattern(rf"\z|{CUT}"))


def add_word_boundary(marker: Marker) -> Split:
    def run(c: Column) -> Column:
        mark = F.lit(marker.substitute)
        if marker.side == Side.ISOLATED:
            return F.array(mark, c)
        if marker.detached:
            return F.array(c, mark) if marker.side == Side.END else F.array(mark, c)
        return F.array(marker.concatenate(c, mark))

    if marker.detached or marker.side == Side.ISOLATED or not marker.substitute:
        return run
    sign = marker.substitute.replace("\\", "\\\\").replace("$", "\\$")
    new = f"$0{sign}" if marker.side == Side.END else f"{sign}$0"
    return marking(run, lambda c: F.regexp_replace(c, f"[^{CUT}]+", new))


def regroup_at_marks(marker: Marker) -> Split:
    """Inverse of add_word_boundary: pieces join into words that begin (or end) with the mark, which goes."""
    def run(c: Column) -> Column:
        text, m = F.array_join(c, ""), F.lit(marker.substitute)
        return _full(F.split(F.replace(text, m, F.lit(CUT)), CUT))

    return run


def add_capital_marker(ignore: Marker = Marker("")) -> Split:
    """Capitals as a sign of their own before the word in small letters."""

    def run(c: Column) -> Column:
        parts = ignore.isolate(c)
        root, mark = parts["root"], parts["mark"]
        first, rest = F.substring(root, 1, 1), F.substring(root, F.lit(2), F.length(root))
        capital = lambda x: (x == F.upper(x)) & (x != F.lower(x))
        return (
            F.when(root == "", _full(F.array(mark)))
            .when(capital(root), F.array(F.lit("⇪"), ignore.concatenate(F.lower(root), mark)))
            .when(capital(first), F.array(F.lit("⇧"), ignore.concatenate(F.concat(F.lower(first), rest), mark)))
            .otherwise(F.array(c))
        )

    return run


def drop_capital_marker(c: Column) -> Column:
    """Inverse of add_capital_marker without an ignored mark."""
    cased = F.transform(
        c,
        lambda x, i: F.when(x.isin("⇪", "⇧"), F.lit(None))
        .when((i > 0) & (F.get(c, i - 1) == "⇪"), F.upper(x))
        .when((i > 0) & (F.get(c, i - 1) == "⇧"), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
        .otherwise(x),
    )
    return F.filter(cased, lambda x: x.isNotNull())


def on_boundary_probabilities(probabilities: Column, threshold: float = 0.5) -> Split:
    """Cut before every character whose predecessor's boundary probability reaches the threshold; a classifier gives them."""

    def run(c: Column) -> Column:
        n = F.length(c)
        cuts = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(probabilities, i - 1) >= threshold)
        edges = F.concat(F.array(F.lit(0)), F.when(n > 1, cuts).otherwise(F.array().cast("array<int>")), F.array(n))
        return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.substring(c, F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i)))

    return run


def mapped(m: Callable[[Column], Column]) -> Split:
    """A mapper on every piece. One that works character by character, and leaves CUT alone, says so by `marked`."""
    split = lambda c: F.array(m(c))
    return marking(split, m.marked) if hasattr(m, "marked") else split


def insert_reverse(c: Column) -> Column:
    return F.array(c, F.reverse(c))


def drop_reverse(c: Column) -> Column:
    return F.filter(c, lambda x, i: i % 2 == 0)


def kudo_words(suffix: bool = False, blank_pieces: bool = False) -> Split:
    """SentencePiece's cut at the marker U+2581: before it (or after it); runs of it may be pieces of their own."""
    m = "▁"
    if not suffix:
        return into_regex_groups(f"{m}*[^{m}]+|{m}+" if blank_pieces else f"{m}?[^{m}]*".replace("*", "+") + f"|{m}")
    return into_regex_groups(f"[^{m}]+{m}*|{m}+" if blank_pieces else f"[^{m}]*{m}|[^{m}]+")


def chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    return reduce(lambda x, s: s(x), steps, c)
