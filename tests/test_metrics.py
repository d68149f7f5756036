"""Metrics on literals, and invariants."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.splitters import on_regex
from tessera.operators import accessors, aggregates, compare, distribution, morphology, tokens, vocab, windows
from tessera.sources import artifacts

WS = on_regex(" +")


def test_mattr_of_the_toy(spark):
    df = spark.createDataFrame([(0, "a a a b b c c a a"), (1, "c c c c")], "doc_id long, text string")
    m = windows.mattr(tokens.positions(df, WS(F.col("text"))), 5, 2).first()
    assert (m.windows, m.mattr) == (5, pytest.approx(0.48))


def test_positions_do_not_depend_on_spans(spark):
    df = spark.createDataFrame([(i, " ".join("abc"[: i % 4])) for i in range(50)], "doc_id long, text string")
    a, b = (sorted(map(tuple, tokens.positions(df, WS(F.col("text")), span=s).collect())) for s in (3, 4096))
    assert a == b and [r[-1] for r in sorted(a, key=lambda r: (r[0], r[1]))] == list(range(len(a)))


def test_accessor_sides_agree(spark):
    df = spark.createDataFrame([(["a", "b"], 50), (["a", "c"], 50), (["c", "b"], 25)], "tokens array<string>, weight long")
    acc = accessors.accessors(df, weight="weight")
    t = {r.side: (r.tokens, r.characters) for r in accessors.totals(acc).collect()}
    assert t["left"] == t["right"] == (250, 250)
    s = {(r.side, r.center): r for r in accessors.summarise(acc).collect()}
    assert s["right", "a"].av == 2 and s["right", "a"].total == 100 and s["left", "a"].boundary_ratio == 1 and s["right", "c"].boundary_ratio == pytest.approx(50 / 75)


def test_entropies(spark):
    c = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "token string, n long")
    assert distribution.shannon(c).first().entropy == pytest.approx(1.5) == distribution.renyi(c, 1).first().entropy
    assert distribution.renyi(c, 2).first().entropy == pytest.approx(1.41503749927)
    one = spark.createDataFrame([("a", 5)], "token string, n long")
    assert distribution.renyi_efficiency(one).first().middle == 1


def test_split_confusion(spark):
    df = spark.createDataFrame([("a bc d ef".split(), "a b cd e f".split())], "a array<string>, b array<string>")
    r = compare.split_confusion(df, "a", "b").first()
    assert (r.tp, r.predicted, r.relevant, r.total) == (2, 3, 4, 5) and r.precision == pytest.approx(2 / 3) and r.recall == 0.5
    assert compare.token_jaccard(df, "a", "b").first().macro == pytest.approx(1 / 8)


def test_morphology(spark):
    df = spark.createDataFrame([("w", ["AAA", "BBBCCC"], ["AAA", "BBB", "CCC"]), ("v", ["A", "AABBBC", "CC"], ["AAA", "BBB", "CCC"])], "k string, t array<string>, m array<string>")
    d = {r.k: (r.tokens, r.morphs, r.contaminated, r.diluted) for r in morphology.dilution(df, "t", "m", "k").collect()}
    assert d["w"] == (2, 3, 0, 0) and d["v"] == (3, 3, 1, 2)
    assert morphology.integrity(df.where("k = 'v'"), "t", "m", "k").first().micro_micro == pytest.approx(7 / 9)
    em = morphology.alignment_em(spark.createDataFrame([(["x", "y"], ["T"]), (["x"], ["T", "U"])], "t array<string>, g array<string>"), "t", "g", 3)
    assert {r.tag: r.s for r in em.groupBy("tag").agg(F.sum("p").alias("s")).collect()} == pytest.approx({"T": 1.0, "U": 1.0}, abs=1e-6)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 8)], "v double, w long")
    r = aggregates.weighted_quantiles(df, "v", "w", [0.1, 0.2, 0.5]).first()
    assert (r.q_0, r.q_1, r.q_2) == (1.0, 2.0, 3.0)
    assert aggregates.weighted_spread(df, "v", "w").first().median == 3.0


def test_vocabulary_ids(spark):
    types = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("a", 3)], "type string, rank int")
    assert {r.type: r.id for r in vocab.absolute_ids(types, [0, 2]).collect()} == {"a": 1, "b": 3, "c": 4}
    ids, special = vocab.relative_ids(types, ["BOS", "EOS"], ["PAD"])
    assert {r.type: r.id for r in ids.collect()} == {"a": 3, "b": 4, "c": 5} and {r.name: r.id for r in special.collect()} == {"BOS": 1, "EOS": 2, "PAD": 6}
    toks = spark.createDataFrame([("a",), ("[BOS]",)], "token string")
    assert {r.token: r.id for r in vocab.to_ids(toks, ids, 0).collect()} == {"a": 3, "[BOS]": 0}
    with pytest.raises(Exception, match="no UNK"):
        vocab.to_ids(toks, ids, None).collect()


def test_artifacts_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("a\tb", 2), ("c", 5)], "word string, count long")
    artifacts.write_word_list(words, f"{tmp_path}/w")
    assert sorted(map(tuple, artifacts.word_list(spark, f"{tmp_path}/w").collect())) == [("a\0b", 2), ("c", 5)]
    (tmp_path / "merges.txt").write_text("#version 1\na b\n\nab c\n")
    assert [r.parts for r in artifacts.merges(spark, str(tmp_path / "merges.txt")).orderBy("priority").collect()] == [["a", "b"], ["ab", "c"]]
    (tmp_path / "events.txt").write_text("+ a b\n- a b\n")
    assert [(r.is_merge, r.parts) for r in artifacts.events(spark, str(tmp_path / "events.txt")).orderBy("event_id").collect()] == [(True, ["a", "b"]), (False, ["a", "b"])]
    calls = []
    make = lambda: calls.append(1) or words
    for _ in range(2):
        assert artifacts.cached(spark, str(tmp_path), "words", {"x": 1}, make).count() == 2
    assert len(calls) == 1


def test_streamed_mattr_sends_positions_to_all_tasks(spark, tmp_path, monkeypatch):
    """A group's tokens aren't gathered in one task to be joined with its position; epochs and both joins give the same."""
    from tessera.streaming import metrics

    for k in range(3):
        rows = [(k * 10 + i, "a" if i % 3 else "b", " ".join(f"w{(i * j + k) % 7}" for j in range(9))) for i in range(10)]
        spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    docs = spark.read.parquet(*(f"{tmp_path}/in/{k}" for k in range(3)))
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    for k in range(3):
        spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/three")
    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or real(df))
    run = lambda path, **more: sorted(tuple(r) for r in metrics.run_mattr(metrics.read(spark, f"{tmp_path}/{path}", **more), "lang", 20, 10).collect())
    once, epochs = run("one"), run("three", maxFilesPerTrigger="1")
    assert len(sent) == 2 + 6
    monkeypatch.setattr(metrics, "MANY", 0)
    assert [r[:2] for r in once] == [r[:2] for r in epochs] and once == run("one") and len(sent) == 8 + 1


def test_overlaps_of_long_and_odd_lists_take_one_walk(spark):
    """With offsets made again for each token, 3000 tokens took minutes."""
    from time import perf_counter

    from tessera.functions import scalars as C

    rows = [("long", ["ab", "c𝒶d"] * 3000, ["abc", "𝒶d"] * 3000), ("odd", ["", "ab", "", "c", ""], ["a", "", "bcd"]), ("none", [], ["a"]), ("null", None, ["a"]), ("last", ["xyz"], ["x", "yz"])]
    df = spark.createDataFrame(rows, "k string, t array<string>, m array<string>")
    began = perf_counter()
    got = sorted(tuple(r) for r in morphology.overlaps(df, "t", "m", "k").collect())
    starts = {r.k: (r.s, r.back) for r in df.select("k", C.token_starts(F.col("t")).alias("s"), C.from_mask(F.array_join("t", ""), C.token_mask(F.filter("t", lambda x: x != ""))).alias("back")).collect()}
    assert perf_counter() - began < 60
    exact = []
    for k, t, m in rows:
        at = lambda ts: [(sum(map(len, ts[:i])), sum(map(len, ts[: i + 1]))) if k != "long" else (5 * (i // 2) + i % 2 * len(ts[0]), 5 * (i // 2) + [len(ts[0]), 5][i % 2]) for i in range(len(ts))]
        ts, ms = at(t or []), at(m)
        for i, (a, b) in enumerate(ms):
            for j, (c, d) in enumerate(ts) if k != "long" else list(enumerate(ts))[max(0, i - 3) : i + 4]:
                if min(b, d) > max(a, c):
                    exact.append((k, i, b - a, min(b, d) - max(a, c), j, d - c))
        assert starts[k][0] == (None if t is None else [a for a, _ in ts])
        if t:
            assert starts[k][1] == [x for x in t if x]
    assert got == sorted(exact)


def test_jaccard_looks_at_each_element_once(spark):
    """Counting each element anew, 40 thousand of them took minutes."""
    from time import perf_counter

    from tessera.functions import scalars as C

    n = 40_000
    rows = [([f"w{i}" for i in range(n)], [f"w{i // 2}" for i in range(n)]), (["a", "a", None], ["a", "b"]), ([], []), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    began = perf_counter()
    got = [r.j for r in df.select(C.jaccard(F.col("a"), F.col("b")).alias("j")).collect()]
    assert perf_counter() - began < 30 and got == pytest.approx([(n / 2) / (1.5 * n), 1 / 3, 1.0, 1.0])
