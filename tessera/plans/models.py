"""Queries over segmenters and trainers. Kernels run once per distinct word; vocabularies come from the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fertility as Y
from tessera.operators.segment import bpe, column, fallback, greedy, lattice, stochastic_column
from tessera.operators.train import bpe as train_bpe
from tessera.operators.train import other, unigram
from tessera.plans.catalog import TOKENS, WORDS, WS, query, table, words

#: The vocabulary of most queries here: this many two- to five-grams of the benchmark's words, and all single characters.
TYPES = 2000


def distinct_words(spark, sf_dir) -> DataFrame:
    return words(spark, sf_dir).select(F.col("token").alias("word")).distinct()


def benchmark_counts(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "benchmark", "text").select(F.explode(WS(F.col("text"))).alias("pretoken"))
    return other.count_words(t)


def once(fit):
    """A model that several queries of a session fit on the same tables is fitted once."""
    kept: dict = {}

    def run(spark, sf_dir):
        key = spark.sparkContext.applicationId, sf_dir
        if key not in kept:
            kept.clear()
            kept[key] = fit(spark, sf_dir)
        return kept[key]

    return run


@once
def vocabulary(spark, sf_dir) -> frozenset[str]:
    v = other.ngram_vocabulary(benchmark_counts(spark, sf_dir), TYPES, 5, 2, 2).select("type").collect()
    letters = benchmark_counts(spark, sf_dir).select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    return frozenset([r[0] for r in v] + [r[0] for r in letters if r[0]])


@once
def merges(spark, sf_dir) -> train_bpe.Result:
    return train_bpe.fit(benchmark_counts(spark, sf_dir), 400)


def segmented(kernel):
    """Per distinct word of documents: number of tokens and a hash of them."""

    def run(spark, sf_dir):
        w = distinct_words(spark, sf_dir).withColumn("t", column(kernel(spark, sf_dir))(F.col("word")))
        return w.select("word", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "\x01").cast("binary")).alias("h"))

    return run


def sampled(kernel):
    def run(spark, sf_dir):
        w = distinct_words(spark, sf_dir)
        w = w.withColumn("t", stochastic_column(kernel(spark, sf_dir))(F.col("word"), F.xxhash64("word")))
        return w.select("word", F.size("t").cast("long").alias("n"), (F.array_join("t", "") == F.col("word")).alias("whole"))

    return run


for _name, _kernel in {
    "tok01_bpe": lambda s, d: bpe.classic(merges(s, d).merges),
    "tok06_bypassed_bpe": lambda s, d: bpe.classic(bpe.bypassed((r := merges(s, d)).merges, {"".join(m) for m in r.merges[5:60:7]})),
    "tok07_picky_bpe": lambda s, d: bpe.events(train_bpe.fit(benchmark_counts(s, d), 300, picky=0.9).events),
    "tok08_scaffold_bpe": lambda s, d: bpe.decomposing((r := train_bpe.fit(benchmark_counts(s, d), 300, scaffold=True)).merges, frozenset(r.removed)),
    "tok09_ensured_bpe": lambda s, d: bpe.classic(bpe.ensured(merges(s, d).merges, ["therefore", "question"])),
    "tok10_shuffled_bpe": lambda s, d: bpe.classic(bpe.shuffled(merges(s, d).merges, 3)),
    "tok11_truncated_bpe": lambda s, d: bpe.classic(bpe.truncated(merges(s, d).merges, 100)),
    "tok12_mergeless_bpe": lambda s, d: bpe.mergeless({t: i for i, t in enumerate(merges(s, d).types())}),
    "tok05_guided_bpe": lambda s, d: bpe.guided(merges(s, d).merges, lambda w, e: 1.0 if e % 4 == 0 else 0.0, 0.5),
    "tok16_left_greedy": lambda s, d: greedy.left_greedy(vocabulary(s, d)),
    "tok17_left_lazy": lambda s, d: greedy.left_lazy(vocabulary(s, d)),
    "tok17_right_greedy": lambda s, d: greedy.right_greedy(vocabulary(s, d)),
    "tok19_pair_passes": lambda s, d: greedy.pair_passes(vocabulary(s, d)),
    "tok20_longest_first": lambda s, d: greedy.longest_first(vocabulary(s, d)),
    "tok20_youngest_first": lambda s, d: greedy.youngest_first((r := merges(s, d)).merges, frozenset(r.alphabet)),
    "tok27_least_tokens": lambda s, d: lattice.least_tokens(vocabulary(s, d)),
    "tok27_longest_product": lambda s, d: lattice.longest_product(vocabulary(s, d)),
    "tok24_boundary_sum": lambda s, d: lattice.boundary_sum(vocabulary(s, d), lambda w: [0.9 if (i + 1) % 3 == 0 else 0.2 for i in range(len(w))]),
    "tok29_top_down": lambda s, d: lattice.top_down(vocabulary(s, d), lambda w: [0.9 if (i + 1) % 3 == 0 else 0.2 for i in range(len(w))]),
    "tok42_syllables": lambda s, d: greedy.syllables(),
    "tok41_derivations": lambda s, d: greedy.derivations(frozenset(r[0] for r in benchmark_counts(s, d).where(F.length("word") >= 3).select("word").collect()), ("un", "re", "in"), ("ed", "ing", "ly", "er", "tion")),
    "wrp07_byte_fallback": lambda s, d: fallback.byte_fallback(greedy.left_greedy(v := vocabulary(s, d)), v),
}.items():
    query(_name)(segmented(_kernel))

for _name, _kernel in {
    "tok02_bpe_dropout": lambda s, d: bpe.dropout(merges(s, d).merges, 0.1),
    "tok03_uniform_merges": lambda s, d: bpe.uniform_merges(merges(s, d).merges, 0.1),
    "tok04_bpe_breakdown": lambda s, d: bpe.breakdown(merges(s, d).merges, 0.33),
    "tok30_uniform_segmentation": lambda s, d: lattice.uniform,
    "tok31_uniform_by_enumeration": lambda s, d: lattice.uniform_by_enumeration(vocabulary(s, d)),
    "tok34_by_path_counts": lambda s, d: lattice.by_path_counts(vocabulary(s, d)),
    "tok36_random_splits": lambda s, d: lattice.random_splits(greedy.left_greedy(v := vocabulary(s, d)), v, 0.5),
}.items():
    query(_name)(sampled(_kernel))


#: Words of the whole table that are types of at most four characters, longest prefix first: as a recursion in SQL.
@query(
    "tok16_left_greedy_sql",
    f"""with recursive v as (select distinct substr(w, i::int, 2) as t from (select distinct unnest({WORDS}) as w from benchmark), unnest(generate_series(1, 40)) g(i) where i < length(w)),
    r as (select token as word, token as rest, 0 as n from (select distinct token from {TOKENS})
          union all select word, case when length(rest) > 1 and left(rest, 2) in (select t from v) then substr(rest, 3) else substr(rest, 2) end, n + 1 from r where rest <> '')
    select word, max(n)::bigint as n from r group by word""",
)
def left_greedy_sql(spark, sf_dir):
    b = benchmark_counts(spark, sf_dir).where(F.length("word") >= 2)
    v = b.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("t")).distinct().collect()
    w = distinct_words(spark, sf_dir).withColumn("t", column(greedy.left_greedy(frozenset(r[0] for r in v)))(F.col("word")))
    return w.select("word", F.size("t").cast("long").alias("n"))


@query("tok15_unigram_viterbi")
def unigram_viterbi(spark, sf_dir):
    model = unigram.fit(benchmark_counts(spark, sf_dir), 500, 2000, 8)
    return segmented(lambda s, d: lattice.unigram(model))(spark, sf_dir)


@query("scl28_segmentation_counts")
def segmentation_counts(spark, sf_dir):
    """ways is infinite beyond doubles; log2_ways tells how many there are."""
    w = distinct_words(spark, sf_dir).withColumn("s", Y.segmentation_doubles(vocabulary(spark, sf_dir))(F.col("word")))
    return w.select("word", "s.ways", F.round("s.log2_ways", 6).alias("log2_ways"))


@query(
    "trn15_ngram_counts",
    f"""with w as (select token, count(*) as n from {TOKENS} group by token),
    g1 as (select substr(token, i::int, 1) as gram, sum(n) as c from w, unnest(generate_series(1, 400)) t(i) where i <= length(token) group by 1 having sum(n) >= 20),
    g2 as (select substr(token, i::int, 2) as gram, sum(n) as c from w, unnest(generate_series(1, 400)) t(i) where i + 1 <= length(token) and (substr(token, i::int, 1) in (select gram from g1) or substr(token, i::int + 1, 1) in (select gram from g1)) group by 1 having sum(n) >= 20)
    select 1 as n, gram, c::bigint as count from g1 union all select 2, gram, c::bigint from g2""",
)
def ngram_counts(spark, sf_dir):
    w = other.count_words(words(spark, sf_dir), "token")
    return other.ngram_counts(w, 2, 20).select(F.col("n").cast("int").alias("n"), "gram", "count")


@query("trn16_count_words", f"select token as word, count(*)::bigint as count from {TOKENS} group by token having count(*) >= 3")
def count_words(spark, sf_dir):
    return other.count_words(words(spark, sf_dir), "token", least=3)


def document_counts(spark, sf_dir) -> DataFrame:
    return other.count_words(words(spark, sf_dir), "token")


def trained(counts=benchmark_counts, **more):
    def run(spark, sf_dir):
        r = train_bpe.fit(counts(spark, sf_dir), 300, **more)
        return spark.createDataFrame([(i, "".join(m), len(m)) for i, m in enumerate(r.merges)], "priority long, type string, parts long")

    return run


#: Each over the words of benchmark, and over those of documents.
for _name, _more in {
    "trn02_bpe_merges": {},
    "trn06_picky_bpe": {"picky": 0.9},
    "trn07_scaffold_bpe": {"scaffold": True},
    "trn09_pmi_bpe": {"objective": "pmi", "least": 3},
    "trn10_smoothed_bpe": {"objective": "smoothed", "least": 3, "stop_ratio": 0.002},
    "trn11_description_length_bpe": {"objective": "description", "least": 3},
}.items():
    query(_name)(trained(**_more))
    query(f"{_name}_documents")(trained(document_counts, **_more))


@query("trn08_trimmed_bpe")
def trimmed(spark, sf_dir):
    c = benchmark_counts(spark, sf_dir)
    return spark.createDataFrame([(t,) for t in sorted(train_bpe.trimmed(c, merges(spark, sf_dir), 3))], "type string")


@query("trn13_unigram_vocabulary_documents")
def unigram_vocabulary_documents(spark, sf_dir):
    return unigram_vocabulary(spark, sf_dir, document_counts)


@query("trn13_unigram_vocabulary")
def unigram_vocabulary(spark, sf_dir, counts=benchmark_counts):
    model = unigram.fit(counts(spark, sf_dir), 500, 2000, 8)
    return spark.createDataFrame(sorted((t, round(p, 6)) for t, p in model.items()), "type string, logp double")


@query("trn14_lzw")
def lzw(spark, sf_dir):
    """Sequential by nature: over the benchmark's texts in their order, whose number is fixed."""
    rows = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", WS(F.col("text")).alias("ws")).orderBy("item_id").collect()
    return spark.createDataFrame(list(enumerate(other.lzw(w for r in rows for w in r["ws"]))), "rank long, type string")


@query("trn19_stems", f"select distinct token as type from (select unnest({WORDS}) as token from benchmark) where length(token) >= 4 and (token || 'ed' in (select token from {TOKENS}) or token || 'ly' in (select token from {TOKENS}))")
def stems(spark, sf_dir):
    t = benchmark_counts(spark, sf_dir).select(F.col("word").alias("type"))
    return other.stems_fine(other.stems_coarse(t, 4), distinct_words(spark, sf_dir), [], ["ed", "ly"])


@query("trn12_boundary_blame")
def boundary_blame(spark, sf_dir):
    from tessera.operators.segment.native import ngrams

    w = benchmark_counts(spark, sf_dir).withColumn("t", column(bpe.classic(merges(spark, sf_dir).merges))(F.col("word"))).withColumn("m", ngrams(4)(F.col("word")))
    return other.boundary_blame(w, "t", "m")


@query("trn18_entropy_constrained_size")
def best_size(spark, sf_dir):
    c = benchmark_counts(spark, sf_dir)
    t = c.select(F.explode(column(bpe.classic(merges(spark, sf_dir).merges))(F.col("word"))).alias("t"), "count").groupBy("t").agg(F.sum("count").alias("n"))
    counts = {r["t"]: float(r["n"]) for r in t.collect()}
    chars = c.agg(F.sum(F.length("word") * F.col("count"))).first()[0]
    size = other.best_size(list(range(50, len(counts) + 1, 50)) or [len(counts)], counts, float(chars))
    return spark.createDataFrame([(size, len(counts))], "size long, types long")


@query("trn20_repeated_sentences", f"select sum(n * (length(token) + 1))::bigint as chars from (select token, count(*) as n from {TOKENS} group by token)")
def repeated_sentences(spark, sf_dir):
    w = other.count_words(words(spark, sf_dir), "token")
    return other.repeated_sentences(w).agg(F.sum(F.length("text") + 1).cast("long").alias("chars"))


@query("str04_streamed_word_counts", f"select token, count(*)::bigint as n from {TOKENS} group by token")
def streamed_counts(spark, sf_dir):
    from tessera.streaming import metrics

    return metrics.run_once(metrics.word_counts(metrics.read(spark, f"{sf_dir}/documents.parquet")), "token")


@query("str08_event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*)::bigint as n from events group by all")
def event_windows(spark, sf_dir):
    from tessera.streaming import metrics

    return metrics.run_once(metrics.event_windows(metrics.read(spark, f"{sf_dir}/events.parquet")), "start")


@query(
    "str06_streamed_mattr",
    f"""with w as (select doc_id, lang, {WORDS} as ws from documents),
    d as (select lang, ws, coalesce(sum(len(ws)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as base from w),
    t as (select lang, unnest(ws) as token, base + unnest(generate_series(0, len(ws) - 1)) as p from d where len(ws) > 0),
    k as (select lang, token, unnest(generate_series(greatest(0, cast(ceil((p - 1999) / 1000.0) as bigint)), cast(p // 1000 as bigint))) as k from t),
    c as (select lang, k, count(distinct token) as types, count(*) as c from k group by lang, k)
    select lang, count(*)::bigint as windows, round(avg(types / 2000.0), 6) as mattr from c where c = 2000 group by lang""",
)
def streamed_mattr(spark, sf_dir):
    from tessera.streaming import metrics

    docs = metrics.read(spark, f"{sf_dir}/documents.parquet")
    return metrics.run_mattr(docs, "lang", 2000, 1000).select("lang", "windows", F.round("mattr", 6).alias("mattr"))
