"""Queries over distributions, windows, accessors, fertility, comparison, morphology and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.functions import splitters as S
from tessera.operators import accessors as A
from tessera.operators import aggregates as G
from tessera.operators import compare as X
from tessera.operators import distribution as D
from tessera.operators import fertility as Y
from tessera.operators import morphology as M
from tessera.operators import tokens as TK
from tessera.operators import windows as W
from tessera.operators.segment import native as N
from tessera.plans.catalog import ORACLES, TOKENS, WORDS, WS, query, table, words

COUNTS = f"(select token, count(*) as n from {TOKENS} group by token)"


def counts(spark, sf_dir, *by):
    return D.unigram(words(spark, sf_dir, *by), by)


@query("agg01_pretoken_counts", f"select token, n::bigint as n from {COUNTS}")
def pretoken_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query("agg04_unigram_by_source", f"select source, token, count(*)::bigint as n from {TOKENS} group by source, token")
def unigram_by_source(spark, sf_dir):
    return counts(spark, sf_dir, "source")


@query("agg04_ensured_types", f"select coalesce(b.token, c.token) as token, coalesce(n, 0)::bigint as n from (select distinct unnest({WORDS}) as token from benchmark) b full join {COUNTS} c on b.token = c.token")
def ensured(spark, sf_dir):
    v = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).select("token").distinct()
    return D.ensured(counts(spark, sf_dir), v)


@query("agg05_ttr_by_lang", f"select lang, count(distinct token)::bigint as types, count(*)::bigint as tokens, round(count(distinct token) / count(*), 6) as ttr from {TOKENS} group by lang")
def ttr(spark, sf_dir):
    return D.ttr(counts(spark, sf_dir, "lang"), ("lang",)).select("lang", "types", "tokens", F.round("ttr", 6).alias("ttr"))


@query("agg06_shannon_by_lang", f"with c as (select lang, token, count(*) as n from {TOKENS} group by lang, token), p as (select lang, n / sum(n) over (partition by lang) as p from c) select lang, round(-sum(p * log2(p)), 6) as entropy from p group by lang")
def shannon(spark, sf_dir):
    return D.shannon(counts(spark, sf_dir, "lang"), ("lang",)).select("lang", F.round("entropy", 6).alias("entropy"))


@query("agg07_renyi_by_lang", f"with c as (select lang, token, count(*) as n from {TOKENS} group by lang, token), p as (select lang, n / sum(n) over (partition by lang) as p from c) select lang, round(log2(sum(pow(p, 2.5))) / (1 - 2.5), 6) as entropy from p group by lang")
def renyi(spark, sf_dir):
    return D.renyi(counts(spark, sf_dir, "lang"), 2.5, ("lang",)).select("lang", F.round("entropy", 6).alias("entropy"))


@query(
    "agg09_renyi_efficiency_by_lang",
    f"with c as (select lang, token, count(*) as n from {TOKENS} group by lang, token), h as (select lang, count(*) as k, sum(n) as t from c group by lang), p as (select lang, log2(sum(pow(n / t, 2.5))) / -1.5 as e, any_value(log2(least(k, t))) as z from c join h using (lang) group by lang) select lang, round(e / ceil(z), 6) as lower, round(e / z, 6) as middle, round(ceil(e) / z, 6) as upper from p",
)
def efficiency(spark, sf_dir):
    e = D.renyi_efficiency(counts(spark, sf_dir, "lang"), 2.5, ("lang",))
    return e.select("lang", *(F.round(c, 6).alias(c) for c in ("lower", "middle", "upper")))


@query("agg10_segmentations", f"select token as word, case when length(token) % 2 = 0 then repeat('01', (length(token) - 1) // 2) || case when (length(token) - 1) % 2 = 1 then '0' else '' end else repeat('01', (length(token) - 1) // 2) end as mask, count(*)::bigint as n from {TOKENS} group by token")
def segmentations(spark, sf_dir):
    t = words(spark, sf_dir).withColumn("pieces", N.ngrams(2)(F.col("token")))
    return D.segmentations(t, "token", "pieces").withColumnRenamed("token", "word")


@query("agg11_segmentation_diversity")
def diversity(spark, sf_dir):
    from tessera.operators.segment import lattice, stochastic_column

    t = TK.repeated(table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.get(WS(F.col("text")), F.lit(0)).alias("word")).dropDuplicates(["word"]), 50)
    t = t.withColumn("pieces", stochastic_column(lattice.uniform)(F.col("word"), F.xxhash64("word", "copy")))
    return D.segmentation_diversity(D.segmentations(t, "word", "pieces"))


@query("agg13_inference_fertility_by_lang", f"""with w as (select lang, token, count(*) as n, length(token) as c, cast(ceil(length(token) / 3.0) as bigint) as k from {TOKENS} group by lang, token)
select lang, count(*)::bigint as types, sum(n)::bigint as tokens, sum(k)::bigint as type_pieces, sum(k * n)::bigint as token_pieces, round(avg(case when c <= 1 then 1.0 else (k - 1) / (c - 1) end), 6) as type_segmentality, round(sum(n * c) / sum(n * k), 6) as token_cpt from w group by lang""")
def inference_fertility(spark, sf_dir):
    t = words(spark, sf_dir, "lang").withColumn("pieces", N.ngrams(3)(F.col("token")))
    f = Y.inference_fertility(t, "pieces", by=("lang",))
    return f.select("lang", "types", *(F.col(c).cast("long").alias(c) for c in ("tokens", "type_pieces", "token_pieces")), *(F.round(c, 6).alias(c) for c in ("type_segmentality", "token_cpt")))


@query("agg12_vocabulary_fertility")
def vocabulary_fertility(spark, sf_dir):
    vocab = table(spark, sf_dir, "benchmark", "text").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring("text", i, F.lit(2)))).alias("t"))
    types = vocab.where(~F.col("t").contains(" ")).distinct().collect()
    letters = frozenset(c for r in types for c in r["t"])
    d = table(spark, sf_dir, "documents", "text").select(F.explode(WS(F.col("text"))).alias("w")).select(F.array("w").alias("ps"))
    return Y.vocabulary_fertility(d, "ps", frozenset(r["t"] for r in types) | letters)


BIGRAM = f"(select doc_id, {WORDS} as ws from documents)"
ACC = f"""(select 'right' as side, ws[i] as center, ws[i + 1] as neighbour from (select ws, unnest(generate_series(1, len(ws))) as i from {BIGRAM} where len(ws) > 0)
union all select 'left', ws[i], case when i > 1 then ws[i - 1] end from (select ws, unnest(generate_series(1, len(ws))) as i from {BIGRAM} where len(ws) > 0))"""


def acc(spark, sf_dir):
    return A.accessors(table(spark, sf_dir, "documents", "doc_id", "text").withColumn("tokens", WS(F.col("text"))))


@query("agg14_accessors", f"select side, center, neighbour, count(*)::double as n from {ACC} group by side, center, neighbour")
def accessors(spark, sf_dir):
    return acc(spark, sf_dir).select("side", "center", "neighbour", "n")


@query(
    "agg15_accessor_summary",
    f"""with a as (select side, center, neighbour, count(*) as n from {ACC} group by all),
    p as (select case when side = 'left' then 'right' else 'left' end as side, count(distinct center) as possible from a where neighbour is not null group by 1),
    i as (select side, center, count(*) as av, sum(n) as m, max(n) as most from a where neighbour is not null group by side, center),
    e as (select side, center, sum(n) as b from a where neighbour is null group by side, center)
    select side, center, (coalesce(m, 0) + coalesce(b, 0))::double as total, round(coalesce(b, 0) / (coalesce(m, 0) + coalesce(b, 0)), 6) as boundary_ratio,
      coalesce(av, 0)::double as av, round(coalesce(av / possible, 0), 6) as coverage, round(coalesce(av / m, 1), 6) as uniqueness, round(coalesce(most / m, 0), 6) as mcu
    from (select * from i full join e using (side, center)) left join p using (side)""",
)
def accessor_summary(spark, sf_dir):
    s = A.summarise(acc(spark, sf_dir))
    return s.select("side", "center", "total", "av", *(F.round(c, 6).alias(c) for c in ("boundary_ratio", "coverage", "uniqueness", "mcu")))


@query("agg16_weaker_side", f"select center, arg_min(side, k) as side, min(av) as av, arg_min(total, k) as total from (select *, av * 2 + (case when side = 'right' then 0 else 1 end) as k from ({ORACLES['agg15_accessor_summary']})) group by center")
def weaker(spark, sf_dir):
    return A.weaker_side(A.summarise(acc(spark, sf_dir))).select("center", "side", "av", "total")


@query("fil06_accessors_without_types", f"select side, center, neighbour, count(*)::double as n from {ACC} where center not in ('the', 'of') and (neighbour is null or neighbour not in ('the', 'of')) group by all")
def accessors_without(spark, sf_dir):
    t = spark.createDataFrame([("the",), ("of",)], "type string")
    return A.without_types(acc(spark, sf_dir), t).select("side", "center", "neighbour", "n")


@query("agg35_corpus_totals", f"select side, count(*)::bigint as tokens, sum(length(center))::bigint as characters from {ACC} group by side")
def corpus_totals(spark, sf_dir):
    return A.totals(acc(spark, sf_dir)).select("side", F.col("tokens").cast("long").alias("tokens"), F.col("characters").cast("long").alias("characters"))


@query("agg14_bucketed_accessors", f"""with t as (select d.doc_id, w.i, ws[w.i] as center, ws[w.i + 1] as neighbour from {BIGRAM} d, unnest(generate_series(1, len(ws) - 1)) w(i)),
b as (select center, neighbour, (row_number() over (partition by center order by doc_id, i) - 1) // 50 as bucket from t)
select center, bucket::bigint as bucket, neighbour, count(*)::double as n from b group by all""")
def bucketed(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("tokens", WS(F.col("text")))
    return A.accessors(d, every=50, order="doc_id").where("side = 'right' and neighbour is not null").select("center", "bucket", "neighbour", "n")


@query("agg17_spreads", "select l_returnflag, round(avg(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr from lineitem group by l_returnflag")
def spreads(spark, sf_dir):
    s = G.spread(table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", ("l_returnflag",))
    return s.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("mean", "median", "iqr")))


QUANT = "with v as (select l_returnflag, l_quantity as v, sum(l_linenumber) as w from lineitem group by all), c as (select *, sum(w) over (partition by l_returnflag order by v) as c, sum(w) over (partition by l_returnflag) as t from v)"


@query("agg21_weighted_quantiles", f"{QUANT} select l_returnflag, min(case when c >= 0.25 * t then v end) as q_0, min(case when c >= 0.5 * t then v end) as q_1, min(case when c >= 0.75 * t then v end) as q_2 from c group by l_returnflag")
def weighted_quantiles(spark, sf_dir):
    return G.weighted_quantiles(table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_linenumber"), "l_quantity", "l_linenumber", [0.25, 0.5, 0.75], ("l_returnflag",))


@query("agg17_weighted_spreads", f"{QUANT} select l_returnflag, round(sum(v * w) / sum(w), 6) as mean, min(case when c >= 0.5 * t then v end) as median, min(case when c >= 0.75 * t then v end) - min(case when c >= 0.25 * t then v end) as iqr from c group by l_returnflag")
def weighted_spreads(spark, sf_dir):
    s = G.weighted_spread(table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_linenumber"), "l_quantity", "l_linenumber", ("l_returnflag",))
    return s.select("l_returnflag", F.round("mean", 6).alias("mean"), "median", "iqr")


#: Two cuts of every distinct word: by three and by four characters.
PAIR = f"""(select token, array_to_string(list_transform(range(0, cast(ceil(length(token) / 3.0) as bigint)), lambda i: (3 * i)::varchar), ',') as x, list_filter(range(0, length(token), 3), lambda i: i > 0) as a, list_filter(range(0, length(token), 4), lambda i: i > 0) as b from (select distinct token from {TOKENS}))"""


def cut_words(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct()
    return t.withColumn("a", N.ngrams(3)(F.col("token"))).withColumn("b", N.ngrams(4)(F.col("token")))


@query("agg18_split_confusion", f"with s as (select sum(len(list_intersect(a, b)))::bigint as tp, sum(len(a))::bigint as predicted, sum(len(b))::bigint as relevant, sum(length(token) - 1)::bigint as total from {PAIR}) select *, round(tp / predicted, 6) as precision, round(tp / relevant, 6) as recall, round(2 * (tp / predicted) * (tp / relevant) / (tp / predicted + tp / relevant), 6) as f1 from s")
def split_confusion(spark, sf_dir):
    c = X.split_confusion(cut_words(spark, sf_dir), "a", "b")
    return c.select(*(F.col(x).cast("long").alias(x) for x in ("tp", "predicted", "relevant", "total")), *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query("agg20_micro_macro", "select round(sum(l_extendedprice) / sum(l_quantity), 4) as micro, round(avg(l_extendedprice / l_quantity), 4) as macro from lineitem where l_quantity <> 0")
def micro_macro(spark, sf_dir):
    a, b = G.micro_macro(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem", "l_extendedprice", "l_quantity").agg(F.round(a, 4).alias("micro"), F.round(b, 4).alias("macro"))


@query("agg20_nested_micro_macro", "with g as (select l_returnflag, sum(l_extendedprice) as n, sum(l_quantity) as d, sum(l_extendedprice / l_quantity) as r, count(*) as k from lineitem group by 1) select round(sum(n) / sum(d), 4) as micro_micro, round(sum(r) / sum(k), 4) as macro_micro, round(avg(n / d), 4) as micro_macro, round(avg(r / k), 4) as macro_macro from g")
def nested(spark, sf_dir):
    n = G.nested_micro_macro(table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity"), "l_returnflag", "l_extendedprice", "l_quantity")
    return n.select(*(F.round(c, 4).alias(c) for c in n.columns))


@query("agg20_mean_std", "select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events group by event_type")
def mean_std(spark, sf_dir):
    m, s = G.mean_std(F.col("value"))
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.round(m, 6).alias("mean"), F.round(s, 6).alias("std"))


OVER = f"""(select token, m, least(3 * m + 3, length(token)) - 3 * m as length, t, least(4 * t + 4, least(3 * m + 3, length(token))) - greatest(4 * t, 3 * m) as best
from (select token, unnest(range(0, cast(ceil(length(token) / 3.0) as bigint))) as m from (select distinct token from {TOKENS})) x, unnest(range(0, cast(ceil(length(token) / 4.0) as bigint))) g(t)
where 4 * t < least(3 * m + 3, length(token)) and least(4 * t + 4, length(token)) > 3 * m)"""


@query("agg22_morph_integrity", f"with b as (select token, m, max(best) as n, max(length) as d from {OVER} group by token, m), g as (select token, sum(n) as n, sum(d) as d, sum(n / d) as r, count(*) as k from b group by token) select round(sum(n) / sum(d), 6) as micro_micro, round(sum(r) / sum(k), 6) as macro_micro, round(avg(n / d), 6) as micro_macro, round(avg(r / k), 6) as macro_macro from g")
def integrity(spark, sf_dir):
    n = M.integrity(cut_words(spark, sf_dir), "b", "a", "token")
    return n.select(*(F.round(c, 6).alias(c) for c in n.columns))


@query("agg23_morph_dilution", f"""with o as {OVER}, k as (select token, t, (count(*) > 1 and bool_or(best < length))::int as bad from o group by token, t),
m as (select token, m, max(case when bad = 1 and best < length then 1 else 0 end) as diluted from o join k using (token, t) group by token, m)
select token, x.tokens::bigint as tokens, y.morphs::bigint as morphs, x.contaminated::bigint as contaminated, y.diluted::bigint as diluted from (select token, count(*) as tokens, sum(bad) as contaminated from k group by token) x join (select token, count(*) as morphs, sum(diluted) as diluted from m group by token) y using (token)""")
def dilution(spark, sf_dir):
    return M.dilution(cut_words(spark, sf_dir), "b", "a", "token")


@query("agg24_alignment_score")
def alignment(spark, sf_dir):
    return M.alignment_score(cut_words(spark, sf_dir), "b", "a", "token")


@query("agg25_alignment_em")
def alignment_em(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark", "text").select(F.explode(WS(F.col("text"))).alias("w")).distinct()
    d = d.select(N.ngrams(2)(F.col("w")).alias("tokens"), F.array(F.right(F.col("w"), F.lit(1)), F.left(F.col("w"), F.lit(1))).alias("tags"))
    return M.alignment_em(d, "tokens", "tags", 3)


@query("agg27_exact_matches", f"select round(avg((string_split(text, ' ') = {WORDS})::int), 6) as exact from documents")
def exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "text").select(F.split("text", " ").alias("a"), WS(F.col("text")).alias("b"))
    return X.exact_matches(d, "a", "b").select(F.round("exact", 6).alias("exact"))


J1 = "list_filter(string_split(text, ' '), lambda x: x <> '')"


@query("agg28_token_jaccard", f"""with t as (select conv_id, turn, unnest({J1}) as w, 0 as side from conversations union all select conv_id, turn, unnest({WORDS}), 1 from conversations),
c as (select conv_id, turn, w, sum((side = 0)::int) as a, sum((side = 1)::int) as b from t group by all), r as (select conv_id, turn, sum(least(a, b)) as s, sum(greatest(a, b)) as u from c group by conv_id, turn)
select round(sum(s) / sum(u), 6) as micro, round(avg(s / u), 6) as macro from r""")
def token_jaccard(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "text").select(S.on_regex(" ")(F.col("text")).alias("a"), WS(F.col("text")).alias("b"))
    return X.token_jaccard(d, "a", "b").select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("agg29_multiplicity_ratio", f"with r as (select len({WORDS})::double as x, ceil(length(text) / 5.0) as y from documents) select round(sum(x) / sum(y), 6) as micro_ab, round(avg(x / y), 6) as macro_ab, round(sum(y) / sum(x), 6) as micro_ba, round(avg(y / x), 6) as macro_ba from r where x > 0 and y > 0")
def multiplicity(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "text").select(WS(F.col("text")).alias("a"), N.ngrams(5)(F.col("text")).alias("b"))
    m = X.multiplicity_ratio(d, "a", "b")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("agg31_normalised", f"select token, n::bigint as n, round(n / sum(n) over (), 9) as p from {COUNTS}")
def normalised(spark, sf_dir):
    return D.normalised(counts(spark, sf_dir)).select("token", "n", F.round("p", 9).alias("p"))


@query("agg31_argmax", f"select token, n::bigint as n from (select *, dense_rank() over (order by n desc) as r from {COUNTS}) where r = 3")
def argmax(spark, sf_dir):
    return D.argmax(counts(spark, sf_dir), 3)


@query("agg33_folds", "select user_id, count(*)::bigint as n, arg_max(event_id, row(value, event_id)) as top, arg_min(event_id, row(value, event_id)) as low from events group by user_id")
def folds(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_id", "value")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("value", "event_id")).alias("top"), F.min_by("event_id", F.struct("value", "event_id")).alias("low"))


@query("agg34_alphabet", "select distinct unnest(list_filter(string_split(text, ''), lambda x: x <> '')) as c from documents")
def alphabet(spark, sf_dir):
    return table(spark, sf_dir, "documents", "text").select(F.explode(N.characters(F.col("text"))).alias("c")).distinct()


@query("agg37_histogram", f"with h as (select floor((length(token) / ceil(length(token) / 3.0) - 1) / 0.25)::bigint as bin, count(*) as n from {TOKENS} group by 1) select bin, round(n / sum(n) over (), 6) as share from h")
def histogram(spark, sf_dir):
    t = words(spark, sf_dir).withColumn("p", N.ngrams(3)(F.col("token")))
    return G.width_bins(t, Y.histogram_inputs(F.col("p"))["cpt"], 1.0, 0.25).select("bin", F.round("share", 6).alias("share"))


@query("agg38_distinct", "select distinct lang, source from documents")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents", "lang", "source").dropDuplicates()


@query("agg39_cube", "select lang, source, count(*)::bigint as n, sum(n_chars)::bigint as chars from documents group by cube(lang, source)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "documents", "lang", "source", "n_chars").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("win02_bigrams", f"select center, neighbour, count(*)::bigint as n from {ACC} where side = 'right' and neighbour is not null group by all having count(*) >= 3")
def bigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "text").select(F.explode(W.zip_offset(WS(F.col("text")), 1)).alias("p"))
    return d.groupBy(F.col("p.a").alias("center"), F.col("p.b").alias("neighbour")).agg(F.count("*").alias("n")).where("n >= 3")


@query("win03_buckets", "select user_id, bucket::bigint as bucket, count(*)::bigint as n, round(sum(value), 4) as value from (select user_id, value, (row_number() over (partition by user_id order by ts, event_id) - 1) // 5 as bucket from events) group by user_id, bucket")
def buckets(spark, sf_dir):
    b = W.buckets(table(spark, sf_dir, "events", "user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], 5)
    return b.groupBy("user_id", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("win05_split_positions", f"select token, len(a)::bigint as n, coalesce(list_sum(a), 0)::bigint as s from {PAIR}")
def positions(spark, sf_dir):
    t = cut_words(spark, sf_dir).withColumn("s", C.split_positions(F.col("a")))
    return t.select("token", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query("win07_collapsed_runs", "select event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is null or p <> event_type")
def runs(spark, sf_dir):
    return W.collapse_runs(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "event_type", "event_id", ("user_id",)).select("event_id", "event_type")


@query("win08_top_words_by_lang", f"select lang, token, n::bigint as n from (select lang, token, count(*) as n, row_number() over (partition by lang order by count(*) desc, token) as r from {TOKENS} group by lang, token) where r <= 20")
def top_words(spark, sf_dir):
    return W.top_by(counts(spark, sf_dir, "lang"), 20, [F.desc("n"), F.col("token")], ("lang",))


@query("win09_periodic_switch", f"with w as (select doc_id, {WORDS} as ws from documents), b as (select doc_id, ws, coalesce(sum(len(ws)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as base from w), t as (select base + unnest(generate_series(0, len(ws) - 1)) as p from b where len(ws) > 0) select (p // 100 % 3)::bigint as choice, count(*)::bigint as n from t group by 1")
def periodic(spark, sf_dir):
    s = TK.positions(table(spark, sf_dir, "documents", "doc_id", "text"), WS(F.col("text")))
    return W.periodic(s, "gpos", 100, 3).groupBy("choice").agg(F.count("*").alias("n"))


@query("srt02_word_list", f"select token as word, n::bigint as count, (row_number() over (order by n desc, token))::bigint as rank from {COUNTS}")
def word_list(spark, sf_dir):
    c = counts(spark, sf_dir).select(F.col("token").alias("word"), F.col("n").alias("count"))
    return W.global_rank(c, F.desc("count"), F.col("word")).withColumn("rank", F.col("rank") + 1)


@query("srt03_top_types", f"select token, n::bigint as n from {COUNTS} order by n desc, token limit 100")
def top_types(spark, sf_dir):
    return counts(spark, sf_dir).orderBy(F.desc("n"), "token").limit(100)


@query("srt05_shuffled_take", "select doc_id from documents order by md5(doc_id::varchar), doc_id limit 50")
def shuffled(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(50)


@query("set01_union", f"select token from (select unnest({WORDS}) as token from documents) union select unnest({WORDS}) from benchmark")
def union(spark, sf_dir):
    b = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).select("token")
    return words(spark, sf_dir).select("token").union(b).distinct()


@query("set02_intersect", f"select token from (select unnest({WORDS}) as token from documents) intersect select unnest({WORDS}) from benchmark")
def intersect(spark, sf_dir):
    b = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).select("token")
    return words(spark, sf_dir).select("token").intersect(b)


@query("set04_multiset_difference", f"select token, n::bigint as n from (select token, sum(s) as n from (select unnest({WORDS}) as token, 1 as s from documents union all select unnest({WORDS}), -1 from benchmark) group by token) where n > 0")
def difference(spark, sf_dir):
    b = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).select("token", F.lit(-1).alias("s"))
    return words(spark, sf_dir).select("token", F.lit(1).alias("s")).unionByName(b).groupBy("token").agg(F.sum("s").alias("n")).where("n > 0")


@query("snk14_assembled_metrics", f"select count(distinct token)::bigint as types_all, count(*)::bigint as tokens_all, count(distinct token) filter (lang = 'en')::bigint as types_en, count(*) filter (lang = 'en')::bigint as tokens_en from {TOKENS}")
def assembled(spark, sf_dir):
    from tessera.sources.artifacts import assemble

    c = counts(spark, sf_dir, "lang")
    whole = c.groupBy("token").agg(F.sum("n").alias("n"))
    pick = lambda d: D.ttr(d).select("types", F.col("tokens").cast("long").alias("tokens"))
    return assemble([("all", pick(whole)), ("en", pick(c.where("lang = 'en'")))])


@query("fac02_conversation_role_fertility", f"with t as (select role, unnest({WORDS}) as token from conversations) select role, count(*)::bigint as tokens, round(sum(length(token)) / sum(ceil(length(token) / 3.0)), 6) as cpt from t group by role")
def role_fertility(spark, sf_dir):
    t = table(spark, sf_dir, "conversations", "role", "text").select("role", F.explode(WS(F.col("text"))).alias("token")).withColumn("p", N.ngrams(3)(F.col("token")))
    f = Y.inference_fertility(t, "p", by=("role",))
    return f.select("role", F.col("tokens").cast("long").alias("tokens"), F.round("token_cpt", 6).alias("cpt"))


@query("substrate_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*)::bigint as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("substrate_nation_revenue", "select n_name, round(sum(o_totalprice), 2) as total, count(*)::bigint as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def nation_revenue(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
