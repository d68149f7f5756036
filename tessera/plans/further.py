"""More queries over segmenters, trainers, metrics and wrappers, with their SQL (recursions are in `sql`)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.functions import splitters as S
from tessera.functions import text as T
from tessera.functions.perturb import constant, gobble
from tessera.operators import aggregates as G
from tessera.operators import compare as X
from tessera.operators import distribution as D
from tessera.operators import preprocess as P
from tessera.operators import tokens as TK
from tessera.operators import vocab as V
from tessera.operators.segment import column, greedy, lattice
from tessera.operators.segment import native as N
from tessera.operators.train import bpe as train_bpe
from tessera.plans import models
from tessera.plans.catalog import ORACLES, TOKENS, WORDS, WS, flagship, query, table, words
from tessera.plans.texts import CHUNKS, VOCAB, benchmark_vocab

ALL = f"(select distinct token from {TOKENS})"


def distinct(spark, sf_dir):
    return words(spark, sf_dir).select("token").distinct()


@query("joi03_word_weights", f"select t.token as word, coalesce(b.n, 1)::double as weight from {ALL} t left join (select unnest({WORDS}) as token, count(*) as n from benchmark group by 1) b using (token)")
def word_weights(spark, sf_dir):
    w = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).groupBy("token").agg(F.count("*").cast("double").alias("w"))
    return TK.weighted(distinct(spark, sf_dir).join(w, "token", "left"), "w").select(F.col("token").alias("word"), "weight")


@query("joi08_accessor_bigrams", f"select a, b, count(*)::bigint as n from (select ws[i] as a, ws[i + 1] as b from (select {WORDS} as ws from documents), unnest(generate_series(1, len(ws) - 1)) g(i)) group by a, b having count(*) >= 4")
def accessor_bigrams(spark, sf_dir):
    """Neighbours of a table of tokens by position; of rows with arrays, `accessors` needs no join."""
    t = words(spark, sf_dir)
    right = t.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("token").alias("b"))
    return t.withColumnRenamed("token", "a").join(right, ["doc_id", "pos"]).groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 4")


@query("agg02_texts_of_counted_words", f"select sum(length(token) * n)::bigint as chars, sum(n)::bigint as n from (select token, count(*) as n from {TOKENS} group by token)")
def texts_of_counted_words(spark, sf_dir):
    c = words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return c.agg(F.sum(F.length("token") * F.col("n")).alias("chars"), F.sum("n").alias("n"))


@query("agg03_merged_word_counts", f"select token as word, count(*)::bigint as count from {TOKENS} group by token having count(*) >= 2")
def merged_word_counts(spark, sf_dir):
    from tessera.operators.train import other

    halves = [words(spark, sf_dir, "doc_id").where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    both = other.count_words(halves[0], "token").unionByName(other.count_words(halves[1], "token"))
    return both.groupBy("word").agg(F.sum("count").alias("count")).where("count >= 2")


@query("agg08_efficiency_in_a_domain", f"with c as (select lang, token, count(*) as n from {TOKENS} group by lang, token), h as (select lang, sum(n) as t from c group by lang) select lang, round(log2(sum(pow(n / t, 2.5))) / -1.5 / any_value(log2(least(50000, t))), 6) as efficiency from c join h using (lang) group by lang")
def efficiency_in_a_domain(spark, sf_dir):
    e = D.renyi_efficiency(D.unigram(words(spark, sf_dir, "lang"), ("lang",)), 2.5, ("lang",), 50_000)
    return e.select("lang", F.round("middle", 6).alias("efficiency"))


CUTS = "length(token) as c, (length(token) - 1) // 6 as tp, (length(token) - 1) // 2 as predicted, (length(token) - 1) // 3 as relevant, length(token) - 1 as total"


@query("agg26_split_counts", f"select token, tp::bigint as tp, predicted::bigint as predicted, relevant::bigint as relevant, total::bigint as total from (select token, {CUTS} from {ALL})")
def split_counts(spark, sf_dir):
    t = distinct(spark, sf_dir).withColumn("a", N.ngrams(2)(F.col("token"))).withColumn("b", N.ngrams(3)(F.col("token")))
    return X.split_confusion(t, "a", "b", by=("token",)).select("token", *(F.col(c).cast("long").alias(c) for c in ("tp", "predicted", "relevant", "total")))


@query("agg19_weighted_confusion", f"select lang, sum(n * tp)::bigint as tp, sum(n * predicted)::bigint as predicted, round(sum(n * tp) / sum(n * predicted), 6) as precision, round(sum(n * tp) / sum(n * relevant), 6) as recall from (select lang, n, {CUTS} from (select lang, token, count(*) as n from {TOKENS} group by lang, token)) group by lang")
def weighted_confusion(spark, sf_dir):
    t = D.unigram(words(spark, sf_dir, "lang"), ("lang",)).withColumn("a", N.ngrams(2)(F.col("token"))).withColumn("b", N.ngrams(3)(F.col("token")))
    c = X.split_confusion(t, "a", "b", "n", ("lang",))
    return c.select("lang", F.col("tp").cast("long").alias("tp"), F.col("predicted").cast("long").alias("predicted"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


query("agg36_ratio_entropy_and_windows", ORACLES["flagship_lang_diversity"])(flagship)


@query("win04_running_weights", "select lang, min(n_chars) filter (c >= 0.5 * t)::bigint as middle from (select lang, n_chars, sum(w) over (partition by lang order by n_chars) as c, sum(w) over (partition by lang) as t from (select lang, n_chars, sum(doc_id % 3 + 1) as w from documents group by lang, n_chars)) group by lang")
def running_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "n_chars", "doc_id").withColumn("w", F.col("doc_id") % 3 + 1)
    return G.weighted_quantiles(d, "n_chars", "w", [0.5], ("lang",)).select("lang", F.col("q_0").cast("long").alias("middle"))


@query("fil08_rows_with_tokens", f"select count(*)::bigint as n, sum(len(ws))::bigint as tokens from (select {WORDS} as ws from documents) where len(ws) > 0")
def rows_with_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "text").select(F.size(WS(F.col("text"))).alias("n")).where("n > 0")
    return d.agg(F.count("*").alias("n"), F.sum("n").alias("tokens"))


@query("set05_offset_vocabularies", f"select '0_' || type as type, rank as id from {VOCAB} where rank < 100 union all select '1_' || type, rank + 100 from {VOCAB}")
def offset_vocabularies(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", F.col("rank").alias("id"))
    return V.combined([v.where("id < 100"), v], [100, 0])


@query("scl21_normalisations", "with v as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as v from embeddings), e as (select vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) as e from v) select vec_id, round(list_max(v) / list_sum(v), 6) as linear, round(list_max(e) / list_sum(e), 6) as soft from e")
def normalisations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("v", F.transform(F.col("embedding").cast("array<double>"), F.abs))
    return e.select("vec_id", F.round(F.array_max(C.normalised(F.col("v"))), 6).alias("linear"), F.round(F.array_max(C.softmax(F.col("v"))), 6).alias("soft"))


@query("map27_certain_perturber", "select doc_id, length(text)::bigint as never, 0::bigint as always from documents")
def certain_perturber(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.length(gobble(0.0, "doc_id")(F.col("text"))).cast("long").alias("never"), F.length(gobble(1.0, "doc_id")(F.col("text"))).cast("long").alias("always"))


@query("map30_index_sampler", "select doc_id, least(length(text), 5)::bigint as n, true as inside from documents")
def index_sampler(spark, sf_dir):
    @F.arrow_udf("array<long>")
    def draw(n: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([np.unique(constant(5)(k, np.random.default_rng(k))).tolist() for k in n.to_pylist()], pa.list_(pa.int64()))

    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("i", draw(F.length("text").cast("long")))
    return d.select("doc_id", F.size("i").cast("long").alias("n"), F.forall("i", lambda x: x < F.length("text")).alias("inside"))


@query("map37_tee", "select 'documents' as metric, count(*)::bigint as n from documents union all select 'languages', count(distinct lang) from documents")
def tee(spark, sf_dir):
    from tessera.streaming.metrics import run_all

    held = {}
    metrics = {"documents": lambda b: b.agg(F.count("*")), "languages": lambda b: b.agg(F.countDistinct("lang"))}
    run_all(table(spark, sf_dir, "documents", "lang"), metrics, lambda name, m: held.update({name: m.first()[0]}))
    return spark.createDataFrame(list(held.items()), "metric string, n long")


@query("spl03_tokeniser_as_splitter", f"select doc_id, md5(array_to_string(flatten(list_transform({WORDS}, lambda token: {CHUNKS})), chr(1))) as h from documents")
def tokeniser_as_splitter(spark, sf_dir):
    tk = P.tokeniser("ngrams", P.Preprocessor(splitter=WS), n=3)
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(F.array_join(tk.prepare_and_tokenise(F.col("text")), "\x01").cast("binary")).alias("h"))


@query("spl22_boundary_probabilities", f"select token, md5(array_to_string(list_transform(range(0, cast(ceil(length(token) / 4.0) as bigint)), lambda i: substr(token, 4 * i + 1, 4)), chr(1))) as h from {ALL}")
def boundary_probabilities(spark, sf_dir):
    t = distinct(spark, sf_dir).withColumn("p", F.expr("transform(sequence(1, length(token)), i -> if(i % 4 = 0, 0.9D, 0.1D))"))
    return t.select("token", F.md5(F.array_join(S.on_boundary_probabilities(F.col("p"))(F.col("token")), "\x01").cast("binary")).alias("h"))


@query("spl29_markers", "select p_partkey, p_brand || '</w>' as sennrich, '▁' || p_brand as kudo, 'Ġ' || p_brand as roberta from part where p_brand is not null")
def markers(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand").where("p_brand is not null")
    return p.select("p_partkey", *(m.concatenate(F.col("p_brand"), F.lit(m.substitute)).alias(n) for n, m in (("sennrich", T.SENNRICH), ("kudo", T.KUDO), ("roberta", T.ROBERTA))))


@query("str07_resumed_counts", f"select token, count(*)::bigint as n from {TOKENS} group by token having count(*) >= 3")
def resumed_counts(spark, sf_dir):
    from tessera.session import shared_folder
    from tessera.streaming import metrics

    counts = metrics.word_counts(metrics.read(spark, f"{sf_dir}/documents.parquet"))
    return metrics.run_once(counts, "token", checkpoint=shared_folder(spark)).where("n >= 3")


@query("tok40_identity_with_vocabulary", f"select token, case when token in (select type from {VOCAB}) then token else '' end as piece from {ALL}")
def identity_with_vocabulary(spark, sf_dir):
    t = V.known(distinct(spark, sf_dir), benchmark_vocab(spark, sf_dir))
    return t.select("token", F.when(F.col("known"), F.col("token")).otherwise("").alias("piece"))


@query("wrp16_own_kernel", f"select token, reverse(token) as r from {ALL}")
def own_kernel(spark, sf_dir):
    return distinct(spark, sf_dir).select("token", F.array_join(column(lambda w: [c for c in reversed(w)])(F.col("token")), "").alias("r"))


@query("sup13_vowels_and_consonants", f"select token, regexp_replace(regexp_replace(token, '[^aeiou]', 'C', 'g'), '[aeiou]', 'V', 'g') as kinds from {ALL}")
def vowels_and_consonants(spark, sf_dir):
    return distinct(spark, sf_dir).select("token", F.regexp_replace(F.regexp_replace("token", "[^aeiou]", "C"), "[aeiou]", "V").alias("kinds"))


# Segmenters and trainers, with recursions as their SQL.
for _name, _kernel in {
    "fil13_at_least_all": lambda s, d: lattice.boundary_sum(models.vocabulary(s, d), lambda w: [0.9 if (i + 1) % 3 == 0 else 0.2 for i in range(len(w))], at_least=True),
    "tok21_squared_lengths": lambda s, d: lattice.viterbi(lambda w, i, j, v=models.vocabulary(s, d): ((j - i) ** 2,) if w[i:j] in v else None, 5, 1, lambda a, b: (a[0] + b[0],)),
    "tok22_longest_token": lambda s, d: lattice.viterbi(lambda w, i, j, v=models.vocabulary(s, d): (j - i,) if w[i:j] in v else None, 5, 1, lambda a, b: (max(a[0], b[0]),)),
    "tok18_alternating": lambda s, d: greedy.alternating(every_letter(s, d)),
    "tok18_both_ends": lambda s, d: greedy.both_ends(every_letter(s, d)),
}.items():
    query(_name)(models.segmented(_kernel))


def every_letter(spark, sf_dir) -> frozenset[str]:
    """The vocabulary with the letters of documents, whose number is bounded by Unicode's."""
    letters = words(spark, sf_dir).select(F.explode(F.split("token", "")).alias("c")).where("c <> ''").distinct().collect()
    return models.vocabulary(spark, sf_dir) | {r[0] for r in letters}


@query("tok35_path_counts")
def path_counts(spark, sf_dir):
    from tessera.operators.fertility import count_segmentations

    return distinct(spark, sf_dir).select("token", count_segmentations(models.vocabulary(spark, sf_dir))(F.col("token")).cast("double").alias("ways"))


@query("srt07_first_pair")
def first_pair(spark, sf_dir):
    c = models.benchmark_counts(spark, sf_dir)
    letters = c.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().count()
    a, b = train_bpe.fit(c, letters + 1).merges[0]
    return spark.createDataFrame([(a, b)], "a string, b string")


@query("trn04_merges_of_types")
def merges_of_types(spark, sf_dir):
    r = train_bpe.fit(models.benchmark_counts(spark, sf_dir), 300)
    back = train_bpe.merges_of_types(["".join(m) for m in r.merges])
    return spark.createDataFrame([(i, "".join(m)) for i, m in enumerate(back)], "priority long, type string")


@query("fil11_unused_types")
def unused_types(spark, sf_dir):
    c = models.benchmark_counts(spark, sf_dir)
    return spark.createDataFrame([(t,) for t in sorted(train_bpe.trimmed(c, models.merges(spark, sf_dir), 0))], "type string")


@query("scl29_pretoken_segmentations")
def pretoken_segmentations(spark, sf_dir):
    from tessera.operators.fertility import log_segmentations

    log = log_segmentations(models.vocabulary(spark, sf_dir))
    w = TK.explode_tokens(table(spark, sf_dir, "benchmark", "item_id", "text"), WS(F.col("text")), "item_id")
    return w.groupBy("item_id").agg(F.round(F.sum(log(F.col("token"))), 4).alias("log2_ways"), F.sum(F.length("token")).cast("long").alias("chars"), F.count("*").alias("pretokens"))
