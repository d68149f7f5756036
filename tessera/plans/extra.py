"""More queries: lattice edges, validations, maps, arrays and vocabulary order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.operators import windows as W
from tessera.operators.segment import native as N
from tessera.plans.catalog import TOKENS, WORDS, WS, query, table, words

BIGRAMS = f"(select distinct substr(w, i::int, 2) as t from (select distinct unnest({WORDS}) as w from benchmark), unnest(generate_series(1, 60)) g(i) where i < length(w))"


def benchmark_bigrams(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark", "text").select(F.explode(WS(F.col("text"))).alias("w")).distinct().where(F.length("w") >= 2)
    return w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("t")).distinct()


@query("joi12_lattice_edges", f"select token, count(*)::bigint as edges from (select token, substr(token, i::int, 2) as t from (select distinct token from {TOKENS}), unnest(generate_series(1, 200)) g(i) where i < length(token)) where t in (select t from {BIGRAMS}) group by token")
def lattice_edges(spark, sf_dir):
    w = words(spark, sf_dir).select("token").distinct().where(F.length("token") >= 2)
    edges = w.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("t"))
    return edges.join(benchmark_bigrams(spark, sf_dir), "t", "left_semi").groupBy("token").agg(F.count("*").alias("edges"))


@query("joi07_two_tokenisations", f"select doc_id, len({WORDS})::bigint as a, ceil(length(text) / 4.0)::bigint as b from documents")
def two_tokenisations(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(WS(F.col("text"))).cast("long").alias("a"), F.size(N.ngrams(4)(F.col("text"))).cast("long").alias("b"))


@query("joi10_shards_merged", f"select token, count(*)::bigint as n from {TOKENS} group by token")
def shards(spark, sf_dir):
    a, b = (words(spark, sf_dir, "lang").where(F.col("lang") == "en" if en else F.col("lang") != "en").groupBy("token").agg(F.count("*").alias("n")) for en in (True, False))
    return a.unionByName(b).groupBy("token").agg(F.sum("n").alias("n"))


@query("joi11_zip_offset", f"select doc_id, greatest(len({WORDS}) - 2, 0)::bigint as pairs from documents")
def zip_offset(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.coalesce(F.size(W.zip_offset(WS(F.col("text")), 2)), F.lit(0)).cast("long").alias("pairs"))


@query("fil14_checks", "select count(*) = count(distinct doc_id) as is_unique, max(doc_id) - min(doc_id) + 1 = count(*) as contiguous, bool_and(n_chars > 0) as positive from documents")
def checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return d.agg((F.count("*") == F.countDistinct("doc_id")).alias("is_unique"), (F.max("doc_id") - F.min("doc_id") + 1 == F.count("*")).alias("contiguous"), F.bool_and(F.col("n_chars") > 0).alias("positive"))


@query("scl06_common_prefix", "select p_partkey, (case when p_brand is null then 0 else list_max([0] || list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: left(p_name, i) = left(p_type, i))) end)::bigint as n from part")
def common_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", C.common_prefix_length(F.col("p_name"), F.col("p_type")).cast("long").alias("n"))


@query("scl41_map_keys", "select r_regionkey::bigint as id, 'renamed' as alias_key from region where r_name = 'ASIA'")
def map_keys(spark, sf_dir):
    m = table(spark, sf_dir, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", "r_regionkey"))).alias("m"))
    return m.select(F.explode(C.substitute_key(F.col("m"), "ASIA", "renamed")).alias("alias_key", "id")).where("alias_key = 'renamed'").select(F.col("id").cast("long").alias("id"), "alias_key")


@query("set07_flattened", f"select lang, count(*)::bigint as n from {TOKENS} group by lang")
def flattened(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "source", "text").groupBy("lang", "source").agg(F.sum(F.size(WS(F.col("text")))).alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("n"))


@query("srt01_types_by_length", f"select token as type, (row_number() over (order by length(token), token) - 1)::bigint as id from (select distinct token from {TOKENS})")
def types_by_length(spark, sf_dir):
    t = words(spark, sf_dir).select(F.col("token").alias("type")).distinct().withColumn("k", F.length("type"))
    return W.global_rank(t, F.col("k"), F.col("type"), out="id").select("type", "id")


@query("srt09_top_prefixes", f"select prefix, n::bigint as n from (select left(token, 2) as prefix, count(*) as n from {TOKENS} group by 1) order by n desc, prefix limit 25")
def top_prefixes(spark, sf_dir):
    return words(spark, sf_dir).groupBy(F.substring("token", 1, 2).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(25)


@query("scl47_prefix_tree_counts", f"select prefix, count(*)::bigint as types, sum(n)::bigint as n from (select left(token, i::int) as prefix, n from (select token, count(*) as n from {TOKENS} group by token), unnest(generate_series(1, 3)) g(i) where i <= length(token)) group by prefix")
def prefix_tree(spark, sf_dir):
    c = words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    p = c.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("token"))), lambda i: F.substring("token", F.lit(1), i))).alias("prefix"))
    return p.groupBy("prefix").agg(F.count("*").alias("types"), F.sum("n").alias("n"))


@query("scl46_language_names", "select lang, case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' end as name, count(*)::bigint as n from documents group by lang")
def language_names(spark, sf_dir):
    names = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")], "lang string, name string")
    return table(spark, sf_dir, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(names), "lang", "left").select("lang", "name", "n")
