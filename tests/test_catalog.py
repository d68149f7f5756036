"""Every query with SQL gives the SQL's rows on the smallest tables; the others run, and every value of theirs is computed."""

import math

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, sf, oracle, name):
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    cur = oracle.execute(SQL[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == names
    assert got == sorted((tuple(plain(r[order.index(c)]) for c in names) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name,texts", [
    ("scl28_segmentation_counts", [" ".join("a" * n for n in range(1, 135)), None]),
    ("wrp08_word_level_unk", ["aaaa aaaa", "aaaa b", "", " ", None]),
])
def test_rows_equal_sql_on_odd_texts(spark, tmp_path, name, texts):
    spark.createDataFrame([(1, "aaaa aaaa")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(SQL[name]).fetchall())


OTHERS = sorted(n for n in catalog.queries() if n not in SQL)


@pytest.mark.parametrize("name", OTHERS)
def test_values_are_computed(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and (name in MAY_BE_NULL or all(v is not None for r in rows for v in r))
    if {"word", "whole"} <= set(df.columns):  # random segmentations write the word
        assert all(r.whole for r in rows)


MAY_BE_NULL = ("agg12_vocabulary_fertility",)


def words_of(sf):
    return [r[0] for r in duckdb.sql(f"select distinct unnest(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) from '{sf}/documents.parquet'").fetchall()]


def test_segmenters_without_sql_against_their_definitions(spark, sf):
    """Brute forms, a word at a time: every pair is looked at again after every merge."""
    import hashlib

    from tessera.plans import models

    merges = models.merges(spark, sf).merges
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    ids = {t: i for i, t in enumerate(models.merges(spark, sf).types())}

    def guided(word):
        tokens = list(word)
        while True:
            ends = [sum(map(len, tokens[: i + 1])) for i in range(len(tokens) - 1)]
            ok = [(rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank and ends[i] % 4]
            if not ok:
                return tokens
            i = min(ok)[1]
            tokens[i : i + 2] = ["".join(tokens[i : i + 2])]

    def mergeless(word):
        tokens = list(word)
        while ok := [(ids[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ids]:
            i = min(ok)[1]
            tokens[i : i + 2] = ["".join(tokens[i : i + 2])]
        return tokens

    def youngest(word):
        score = {c: -1.0 for c in models.merges(spark, sf).alphabet} | {"".join(m): float(i) for i, m in enumerate(merges)}
        found = [(-score[word[i:j]], -(j - i), i) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in score]
        if not found:
            return list(word)
        _, n, i = min(found)
        return ([*youngest(word[:i])] if i else []) + [word[i : i - n]] + (youngest(word[i - n :]) if i - n < len(word) else [])

    some = words_of(sf)[::17]
    for name, brute in (("tok05_guided_bpe", guided), ("tok12_mergeless_bpe", mergeless), ("tok20_youngest_first", youngest)):
        got = {r.word: r for r in catalog.queries()[name](spark, sf).collect()}
        for w in some:
            tokens = brute(w)
            assert (got[w].n, got[w].h) == (len(tokens), hashlib.md5("\x01".join(tokens).encode()).hexdigest()), (name, w)


def test_k_best_against_enumeration():
    import math

    import numpy as np

    from tessera.operators.segment import lattice

    logp = {t: -0.7 * i for i, t in enumerate("a b c ab bc abc ca cab".split())}
    for word in ("abcabc", "cabab", "", "abx"):
        every = sorted(((sum(logp[t] for t in w), w) for w in lattice.all_segmentations(word, frozenset(logp))), key=lambda x: -x[0])
        best = lattice.k_best(word, logp, 5)
        assert [round(s, 9) for s, _ in best] == [round(s, 9) for s, _ in every[:5]] and all("".join(t) == word for _, t in best)
    rng = np.random.default_rng(3)
    draws = [tuple(lattice.unigram_sampled(logp, 3)("abc", rng)) for _ in range(4000)]
    best = lattice.k_best("abc", logp, 3)
    total = sum(math.exp(s) for s, _ in best)
    for s, t in best:
        assert abs(draws.count(tuple(t)) / 4000 - math.exp(s) / total) < 0.03
    assert lattice.unigram_sampled(logp)("xyz", rng) == ["x", "y", "z"]


def test_grids_and_gold_boundaries():
    import math

    from tessera.operators.segment import lattice

    vocab = frozenset(["a", "b", "ab", "ba"])
    score = lambda w, i, j: math.log(j - i) if w[i:j] in vocab else None
    cells = lattice.grid(score, "abab", 2)
    assert cells[0] == [0.0, math.log(2)] and len(cells[3]) == 1
    assert lattice.to_probabilities(cells)[0] == [1.0, 2.0] and lattice.with_strings(cells, "abab")[1] == [(0.0, "b"), (math.log(2), "ba")]
    assert lattice.discretised([[0.1, 0.34, 0.99, 1.0, -5.0, None]], 0.0, 1.0, 3) == [[0.0, 0.5, 1.0, 1.0, -5.0, None]]
    assert lattice.of_grid(lambda w: lattice.grid(score, w, 2), 2)("abab") == ["ab", "ab"]
    assert lattice.gold_boundary({"abcd": ["ab", "c", "d"]}, 1)("Gabcd") == [0.0, 0.0, 1.0, 1.0, 0.0]


def test_vocabulary_upkeep(spark):
    from tessera.operators import vocab

    assert vocab.repaired(3, {"a": 0, "b": 9, "c": 10}) == {"a": 0, "b": 4, "c": 5}
    flat = spark.createDataFrame([("<s>", 0), ("x", 1), ("y", 2)], "type string, id long")
    types, specials, unk = vocab.split_flat(flat, {"BOS": "<s>"})
    assert sorted(r.type for r in types.collect()) == ["x", "y"] and specials == {"BOS": 0} and unk is None
    for bad in ({"BOS": "no"}, {"UNK": "<s>"}):
        with pytest.raises(ValueError):
            vocab.split_flat(flat, bad)
    with pytest.raises(ValueError):
        vocab.split_flat(flat.where("id <> 1"), {"BOS": "<s>"})


def test_marking_splitters_equal_nested_ones(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.functions import splitters as S
    from tessera.functions import text as T
    from tessera.functions.bytes import pseudo_bytes

    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aAbé漢 '\t.-–_12,’ns't\u200b…!ﬁ") for _ in range(rng.randrange(0, 40)))) for i in range(500)] + [(900, None), (901, "I'll don't 'q' it's-a 1,234.5 --- can't. '' n't")]
    df = spark.createDataFrame(rows, "id int, t string")
    excluded = S.isolate_punctuation("excluded")
    for steps in (
        [excluded, S.on_whitespace(), S.isolate_contractions(), S.mapped(pseudo_bytes()), S.add_word_boundary(T.ROBERTA), S.isolate_digits, S.isolate_punctuation("only")],
        [S.on_whitespace(), S.group_digits(3), S.isolate_connecting_hyphens, S.isolate_numbers, S.add_word_boundary(T.SENNRICH)],
        [S.isolate_digits, S.isolate_punctuation("included", True, T.Side.START)],
        [S.isolate_digits, S.isolate_punctuation("included", True, T.Side.END)],
    ):
        assert not df.where(~S.sequence(*steps)(F.col("t")).eqNullSafe(S.nested(*steps)(F.col("t")))).count()
