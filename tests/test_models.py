"""Segmenters and trainers on small literals, with properties instead of goldens where results are random."""

import itertools

import numpy as np
import pytest

from tessera.operators.segment import bpe, fallback, greedy, lattice
from tessera.operators.train import bpe as train
from tessera.operators.train import other, unigram

MERGES = [("a", "b"), ("ab", "c"), ("b", "c"), ("ab", "ab")]
VOCAB = frozenset("re anim atie reanim at ie a e r n i m t ean".split())


def test_bpe_applies_earlier_merges_first():
    run = bpe.classic(MERGES)
    assert run("abcbcab") == ["abc", "bc", "ab"] and run("abab") == ["abab"] and run("") == [] and run("x") == ["x"]
    assert bpe.classic([("a", "b", "c")])("abcab") == ["abc", "a", "b"]


def test_bpe_long_words_equal_short_ones():
    rng = np.random.default_rng(0)
    for _ in range(30):
        word = "".join(rng.choice(list("abc"), 60))
        tokens = list(word)
        rank = bpe.ranks(MERGES)
        while found := [rank[p] for p in zip(tokens, tokens[1:]) if p in rank]:
            tokens = bpe._apply(tokens, MERGES[min(found)])
        assert bpe.classic(MERGES)(word) == tokens


def test_dropout_extremes():
    rng = np.random.default_rng(0)
    for w in ("abcbcab", "abab"):
        assert bpe.dropout(MERGES, 0.0)(w, rng) == bpe.classic(MERGES)(w) and bpe.dropout(MERGES, 1.0)(w, rng) == list(w)
    assert "".join(bpe.breakdown(MERGES, 0.5)("ababc", rng)) == "ababc"


def test_bpe_variants():
    assert bpe.decomposing(MERGES, frozenset(["abc"]))("abc") == ["ab", "c"]
    assert bpe.mergeless({"ab": 5, "bc": 1})("abc") == ["a", "bc"]
    assert bpe.events([(True, ("a", "b")), (True, ("ab", "c")), (False, ("a", "b"))])("abcab") == ["abc", "a", "b"]
    assert bpe.bypassed(MERGES, {"ab"})[0] == ("a", "b", "c")
    assert bpe.classic(bpe.ensured(MERGES, ["cab"]))("cab") == ["cab"]
    assert sorted(bpe.shuffled(MERGES, 1)) == sorted(MERGES)


def test_greedy_family():
    v = frozenset(["a", "b", "c", "ab", "abc", "bcd", "d"])
    assert greedy.left_greedy(v)("abcd") == ["abc", "d"] and greedy.right_greedy(v)("abcd") == ["a", "bcd"]
    assert greedy.left_greedy(frozenset("abcLn"))("L𝒶n") == ["L", "𝒶", "n"]
    assert greedy.longest_first(v)("abcd") == ["abc", "d"] and greedy.pair_passes(v)("abcd") == ["abc", "d"]
    assert greedy.alternating(v)("abcd") == ["abc", "d"] and greedy.both_ends(v, False)("abcd") == ["a", "bcd"]
    with pytest.raises(ValueError):
        greedy.alternating(v)("x")
    assert [greedy.syllables()(w) for w in ("türkiye", "kardeş", "trabzon")] == [["tür", "ki", "ye"], ["kar", "deş"], ["t", "rab", "zon"]]


def test_lattices_against_enumeration():
    word = "reanimatie"
    ways = list(lattice.all_segmentations(word, VOCAB))
    assert lattice.path_counts(word, VOCAB.__contains__)[-1] == len(ways) > 1
    assert len(lattice.least_tokens(VOCAB)(word)) == min(map(len, ways))
    assert np.prod([len(t) for t in lattice.longest_product(VOCAB)(word)]) == max(np.prod([len(t) for t in w]) for w in ways)
    logp = {t: -1.0 / len(t) for t in VOCAB}
    assert sum(logp[t] for t in lattice.unigram(logp)(word)) == pytest.approx(max(sum(logp[t] for t in w) for w in ways))
    assert sum(lattice.joint_probability(word, w, VOCAB) for w in ways) == pytest.approx(1)
    assert lattice.least_tokens(VOCAB)("xyz") == ["x", "y", "z"]


def test_random_segmentations_are_uniform():
    word, rng = "reanim", np.random.default_rng(1)
    ways = [tuple(w) for w in lattice.all_segmentations(word, VOCAB)]
    for kernel in (lattice.by_path_counts(VOCAB), lattice.uniform_by_enumeration(VOCAB)):
        seen = [tuple(kernel(word, rng)) for _ in range(3000)]
        counts = np.array([seen.count(w) for w in ways])
        assert counts.sum() == 3000 and (((counts - 3000 / len(ways)) ** 2) / (3000 / len(ways))).sum() < 3 * len(ways) + 12
    assert "".join(lattice.random_splits(greedy.left_greedy(VOCAB), VOCAB, 1.0)(word, rng)) == word


def test_graph():
    g = lattice.Graph([[1, 2, 4], [3, 4], [3], [4, 5], [5], []])
    assert g.total_paths() == 6
    path, p = g.sample(np.random.default_rng(0))
    assert g.probability(path) == pytest.approx(p)


def test_fallback():
    assert fallback.byte_fallback(greedy.left_greedy(frozenset("ab")), frozenset("ab"))("aé") == ["a", "[BYTE 195]", "[BYTE 169]"]
    assert fallback.aligned_unknowns("xxaby", [None, "ab", None, None]) == ["xx", "ab", "y"]


WORDS = [(w, n) for w, n in (("ab", 5), ("abab", 2), ("abc", 3), ("cd", 1), ("xyzw", 1), ("aaaa", 2))]


def brute_bpe(words, size):
    words, merges = [(list(w), n) for w, n in words], []
    alphabet = {c for w, _ in words for c in w}
    while len(alphabet) + len(merges) < size:
        counts = {}
        for w, n in words:
            skip = False
            for i, p in enumerate(zip(w, w[1:])):
                skip = not skip and i > 0 and w[i - 1] == p[0] == p[1]
                if not skip:
                    counts[p] = counts.get(p, 0) + n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        merges.append(best)
        words = [(train.merge_pair(w, best), n) for w, n in words]
    return merges


def test_bpe_trainer_against_recounting():
    assert train.fit_words(WORDS, 16).merges == brute_bpe(WORDS, 16)
    rng = np.random.default_rng(0)
    many = [("".join(rng.choice(list("abcd"), rng.integers(1, 9))), int(rng.integers(1, 20))) for _ in range(150)]
    many = [(w, n) for w, n in dict(many).items()]
    assert train.fit_words(many, 40).merges == brute_bpe(many, 40)
    for more in ({"objective": "pmi"}, {"objective": "smoothed"}, {"objective": "description"}, {"scaffold": True}, {"picky": 0.8}):
        assert train.fit_words(many, 30, **more).merges


@pytest.mark.parametrize("more", [{}, {"objective": "pmi", "least": 2}, {"objective": "smoothed"}, {"objective": "description"}, {"picky": 0.8}, {"scaffold": True}])
def test_bpe_trainer_gives_the_same_merges_in_the_cluster(spark, monkeypatch, more):
    monkeypatch.setattr(train._Cluster, "EVERY", 4)
    rng = np.random.default_rng(4)
    many = dict(WORDS) | {"".join(rng.choice(list("abcd"), rng.integers(1, 9))): int(rng.integers(1, 9)) for _ in range(60)} | {"aaaa": 10, "bc": 25}
    counts = spark.createDataFrame(list(many.items()), "word string, count long")
    local, cluster = (train.fit(counts, 20, driver_words=n, **more) for n in (10**6, 0))
    assert local == cluster and len(local.merges) > 5


def test_bpe_trainer_skips_overlaps_in_the_cluster(spark):
    counts = spark.createDataFrame([("aaaa", 10), ("bc", 25)], "word string, count long")
    for n in (0, 10):
        assert train.fit(counts, 5, driver_words=n).merges == [("b", "c"), ("a", "a")]


def test_bpe_trainer_leaves_many_words_in_the_cluster(spark, monkeypatch):
    """Beyond 100 thousand words nothing of them comes to the driver; a round tells only what moved."""
    monkeypatch.setattr(train, "fit_words", None)
    words = spark.range(120_000).selectExpr("concat('ab', id, 'aa') as word", "1l as count")
    r = train.fit(words, 15)
    assert r.alphabet == [*"0123456789ab"] and r.merges == [("a", "a"), ("a", "b"), ("ab", "1")]


def test_bpe_steps_on_numbers_against_lists():
    rng = np.random.default_rng(7)
    for wide in (1, 40_000):  # numbers that need two bytes, and more
        words = [list(rng.integers(1, 4, rng.integers(1, 9)) * wide) for _ in range(200)]
        n = rng.integers(1, 9, len(words))
        t = np.array([x for w in words for x in [*w, 0]], np.uint16 if wide == 1 else np.int32)
        steps = [(1, 70_000, (wide, wide)), (1, 5 * wide, (2 * wide, 70_000)), (0, 70_000, (wide, wide))]
        for step in steps:
            kind, made, parts = step
            t, keys, by = train._moved(t, n, step)
            after = []
            for w in words:
                out, i = [], 0
                while i < len(w):
                    hit = w[i : i + 2] == list(parts) if kind else w[i] == made
                    out += ([made] if kind else list(parts)) if hit else [w[i]]
                    i += 2 if kind and hit else 1
                after.append(out)
            exact = {}
            for sign, side in ((-1, words), (1, after)):
                for w, k in zip(side, n):
                    for x in [*train.pairs_of(w), *((y, 0) for y in w)]:
                        exact[int(x[0]) << 32 | int(x[1])] = exact.get(int(x[0]) << 32 | int(x[1]), 0) + sign * int(k)
            assert t.tolist() == [x for w in after for x in [*w, 0]]
            assert dict(zip(keys.tolist(), by.tolist())) == {k: x for k, x in exact.items() if x}
            words = after


def test_merges_of_types():
    r = train.fit_words(WORDS, 14)
    assert train.merges_of_types(["".join(m) for m in r.merges]) == r.merges


def test_expectations_against_enumeration():
    logp = {t: -0.3 * (i + 1) for i, t in enumerate(sorted(VOCAB))}
    ways = list(lattice.all_segmentations("reanim", VOCAB))
    weight = [np.exp(sum(logp[t] for t in w)) for w in ways]
    total, uses = unigram.expectations("reanim", logp, 8)
    assert total == pytest.approx(np.log(sum(weight)))
    for t in VOCAB:
        assert uses.get(t, 0) == pytest.approx(sum(p * w.count(t) for p, w in zip(weight, ways)) / sum(weight))


def test_expectations_of_many_words_at_once(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("reanimt"), k)) for k in rng.integers(1, 12, 300)] + ["e" * 900, "𝒶nim", "", "xyz"]
    n = rng.integers(1, 9, len(words)).tolist()
    logp = {t: -0.3 * (i + 1) for i, t in enumerate(sorted(VOCAB | {"𝒶"}))} | {"e": -1020.0}
    exact: dict = {}
    for w, k in zip(words, n):
        for t, x in unigram.expectations(w, logp, 8)[1].items():
            exact[t] = exact.get(t, 0.0) + k * x
    counts = spark.createDataFrame(list(zip(words, n)), "word string, count long")
    assert unigram.em_step(counts, logp) == pytest.approx(exact)


def test_unigram_trainer_counts_words_once(spark):
    from pyspark.sql import functions as F

    looked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(n):
        looked.add(1)
        return n

    counts = spark.createDataFrame([(w, 3) for w in ("reanim", "anim", "animate", "rean")], "word string, count long")
    unigram.fit(counts.withColumn("count", seen("count")), 12, 40, 8)
    assert looked.value == 4


def test_lzw_and_ngrams(spark):
    v = other.lzw("there is a house in your backyard -- a treehouse you might say".split(), 60)
    assert len(v) == len(set(v)) and set("".join(v)) <= set(v)
    words = spark.createDataFrame([("abab", 3), ("abc", 2)], "word string, count long")
    got = {(r.n, r.gram): r["count"] for r in other.ngram_counts(words, 2, 1).collect()}
    exact = {}
    for (w, n), k in itertools.product([("abab", 3), ("abc", 2)], (1, 2)):
        for i in range(len(w) - k + 1):
            exact[k, w[i : i + k]] = exact.get((k, w[i : i + k]), 0) + n
    assert got == exact
    assert [r.type for r in other.ngram_vocabulary(words, 3, 2).orderBy("rank").collect()] == sorted([r for r, in [("a",), ("b",), ("ab",)]], key=lambda t: (len(t), t))


def test_long_words_and_large_vocabularies_are_whole(spark, tmp_path):
    from tessera.plans import metrics, models

    letters = "".join(chr(0x4E00 + i) for i in range(6002))
    for name, rows in (("a", [(1, "aaaa aaaa")]), ("b", [(1, letters)])):
        spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    spark.createDataFrame([(1, "a" * 101 + " " + "a" * 3000, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, letters[-3:-1], "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = {len(r.word): r for r in models.segmentation_counts(spark, f"{tmp_path}/a").collect()}
    assert sorted(got) == [101, 3000] and got[3000].ways == float("inf") and got[3000].log2_ways > 1024
    assert abs(got[101].ways / 2 ** got[101].log2_ways - 1) < 1e-9
    assert metrics.vocabulary_fertility(spark, f"{tmp_path}/b").first().type_per_word == 2
