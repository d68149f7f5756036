"""Mappers, splitters and scalars on small literals."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import bytes as B
from tessera.functions import perturb as P
from tessera.functions import scalars as C
from tessera.functions import splitters as S
from tessera.functions import text as T


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_mappers(spark):
    assert run(spark, ["  a \x1c", None], T.strip) == ["a", None]
    assert run(spark, ["hello world foo bar", "short"], T.truncate_at_blank(13)) == ["hello world", "short"]
    assert run(spark, ["hello world foo bar"], T.truncate_at_blank(13, 50, True)) == ["hello world foo"]
    assert run(spark, ["x" * 30], T.truncate_at_blank(13)) == ["x" * 13]
    assert run(spark, ["aaaabbbc\n\n\n"], T.limit_repetitions(2)) == ["aabbc\n\n"]
    assert run(spark, ["see http://a.b.com/x?y=1. ok"], T.filter_hyperlinks) == ["see . ok"]
    assert run(spark, ["１ﬁ", "plain"], T.normalise()) == ["1fi", "plain"]
    both = T.compose_invertible(T.replace("a", "b"), T.append_space())
    assert run(spark, ["cat"], lambda c: both.invert(both(c))) == ["cat"]
    with pytest.raises(ValueError):
        T.replace("", "x")


def test_markers(spark):
    assert run(spark, ["ab</w>", "ab", "</w>"], T.SENNRICH.atomise) == [["a", "b</w>"], ["a", "b"], ["</w>"]]
    assert run(spark, ["▁ab"], T.KUDO.atomise) == [["▁a", "b"]]
    assert run(spark, ["▁ab"], T.Marker("▁").atomise) == [["▁", "a", "b"]]
    m = T.replace_boundary(" ", T.KUDO)
    assert run(spark, [" a b", "a"], m) == ["▁a b", "a"] and run(spark, [" a b"], lambda c: m.invert(m(c))) == [" a b"]


@pytest.mark.parametrize("table", [B.pseudo_table(), B.latin_table()])
def test_byte_tables(spark, table):
    assert len(set(table)) == 256 and sum(ord(c) > 255 for c in B.pseudo_table()) == 68
    m, texts = B.ByteMapper(table), ["Life could be a drëam!", "漢😀", ""]
    assert run(spark, texts, lambda c: m.invert(m(c))) == texts


def test_splitters(spark):
    assert run(spark, ["Was \"x\": y...! 'a', it's"], S.isolate_punctuation("excluded")) == [["Was ", '"', "x", '":', " y", "...!", " ", "'", "a", "',", " it's"]]
    assert run(spark, [" a b  c", "a", " "], S.on_whitespace_marked(T.KUDO)) == [["▁a", "▁b", "▁c"], ["a"], []]
    assert run(spark, ["1234567 ab12"], S.group_digits(3)) == [["1", "234", "567", " ab", "12"]]
    assert run(spark, ["they'll", "pa'que", "I'''m", "'m"], S.polarise_apostrophes()) == [["they", "'ll"], ["pa'", "que"], ["I'", "'", "'m"], ["'m"]]
    assert run(spark, ["can't they'd've"], S.sequence(S.on_whitespace(), S.isolate_contractions())) == [["ca", "n't", "they", "'d", "'ve"]]
    assert run(spark, ["3.14, 5"], S.isolate_numbers) == [["3.14", ", ", "5"]]
    assert run(spark, ["well-known a -- b"], S.isolate_connecting_hyphens) == [["well", "-", "known a -- b"]]
    assert run(spark, [None], S.sequence(S.on_whitespace())) == [None]


def test_inverses(spark):
    texts = ["HELLO", "Hello", "hello", "Éa"]
    assert run(spark, texts, lambda c: F.array_join(S.drop_capital_marker(S.add_capital_marker()(c)), "")) == texts
    assert run(spark, ["a-b c"], lambda c: S.join_connecting_hyphens(S.isolate_connecting_hyphens(c))) == [["a-b c"]]
    assert run(spark, ["abc"], lambda c: S.drop_reverse(S.insert_reverse(c))) == [["abc"]]


def test_perturbations_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"some text number {i}") for i in range(40)], "i int, t string")
    for m in (P.pop(0.7, 0.2), P.insert(0.7, P.constant(2)), P.substitute(0.7, P.fixed_uniform(1, 3)), P.keyboard_typos(0.7, P.geometric(0.3, 4))):
        one, many = (sorted(map(tuple, df.repartition(n).select("i", m(F.col("t")).alias("x")).collect())) for n in (1, 5))
        assert one == many and any(x != f"some text number {i}" for i, x in one)


def test_keys_of_compositions_are_a_bijection():
    for n in range(1, 9):
        keys = [C.loc_key(c) for c in C.compositions(n)]
        assert sorted(keys) == list(range(2 ** (n - 1)))


def test_isomorphic_encodings(spark):
    df = spark.createDataFrame([(["ab", "c", "def"],)], "t array<string>")
    r = df.select(C.token_starts(F.col("t")).alias("s"), C.token_mask(F.col("t")).alias("m"), C.bit_key(C.token_lengths(F.col("t"))).alias("k"), C.cut_at(F.lit("abcdef"), C.token_starts(F.col("t"))).alias("c"), C.from_mask(F.lit("abcdef"), C.token_mask(F.col("t"))).alias("f")).first()
    assert (r.s, r.m, r.k, r.c, r.f) == ([0, 2, 3], "01100", 12, ["ab", "c", "def"], ["ab", "c", "def"])


def test_chunks_of_long_texts_take_one_walk(spark):
    """By substrings or slices, 400 thousand characters took minutes."""
    from time import perf_counter

    from tessera.operators import vocab as V
    from tessera.operators.segment import native as N

    long = "añ𝒶d " * 80_000
    df = spark.createDataFrame([(0, long), (1, "abcdefg"), (2, "abc"), (3, ""), (4, None)], "i int, t string").cache()
    df.count()
    began = perf_counter()
    got = {r.i: r for r in df.select("i", N.strided_ngrams(5, 2)(F.col("t")).alias("a"), N.strided_ngrams(1, 5)(F.col("t")).alias("b"), V.succession(N.ngrams(4), V.joined_in(2))(F.col("t")).alias("c")).collect()}
    assert perf_counter() - began < 30
    chunks = lambda t, n, stride: [t[i * stride : i * stride + n] for i in range(max(0, -((n - len(t)) // stride)) + 1)]
    for i, t in enumerate([long, "abcdefg", "abc", ""]):
        assert got[i].a == chunks(t, 5, 2) and got[i].b == chunks(t, 1, 5)
        assert got[i].c == [t[k : k + 8] for k in range(0, len(t), 8)]
    assert got[4].a is None and got[4].c is None
