"""Queries over stores (written and read back), vocabularies' upkeep, wrappers, samples, frames and formatting."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import bytes as B
from tessera.functions import scalars as C
from tessera.functions import splitters as S
from tessera.functions import text as T
from tessera.operators import aggregates as G
from tessera.operators import preprocess as P
from tessera.operators import tokens as TK
from tessera.operators import vocab as V
from tessera.operators import windows as W
from tessera.operators.segment import native as N
from tessera.plans.catalog import ORACLES, TOKENS, WORDS, WS, query, table, words
from tessera.plans.texts import CHUNKS, VOCAB, benchmark_vocab
from tessera.session import shared_folder
from tessera.sources import artifacts as A

BENCHMARK = f"(select unnest({WORDS}) as token from benchmark)"
COUNTS = f"(select token, count(*)::bigint as n from {TOKENS} group by token)"


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def counted(spark, sf_dir):
    return words(spark, sf_dir).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("count"))


def benchmark_words(spark, sf_dir):
    return TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text")))


# Stores: what is written is read back.


@query("src01_word_list_read_back", f"select token as word, n as count from {COUNTS}")
def word_list(spark, sf_dir):
    A.write_word_list(counted(spark, sf_dir), path := folder(spark, "words"), ordered=False)
    return A.word_list(spark, path)


@query("src02_counter", "select lang as word, count(*)::bigint as count from documents group by lang")
def counter(spark, sf_dir):
    counts = {r["lang"]: r["count"] for r in table(spark, sf_dir, "documents", "lang").groupBy("lang").count().collect()}
    return A.from_counter(spark, counts)


@query("src03_word_iterable", f"select token as word, count(*)::bigint as count from {BENCHMARK} group by token")
def word_iterable(spark, sf_dir):
    from tessera.operators.train import bpe

    return bpe.word_counts(benchmark_words(spark, sf_dir).select(F.col("token").alias("word"), F.lit(1).alias("count")))


@query("src04_lines_of_files", "select length(trim(x, chr(9) || ' '))::bigint as n, count(*)::bigint as c from (select unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) as x from benchmark) where trim(x, chr(9) || ' ') <> '' group by 1")
def lines_of_files(spark, sf_dir):
    table(spark, sf_dir, "benchmark", "text").write.text(path := folder(spark, "lines"))
    return A.lines(spark, path).groupBy(F.length("text").cast("long").alias("n")).agg(F.count("*").alias("c"))


ORACLES["src11_stripped_lines"] = ORACLES["src04_lines_of_files"].replace(" where trim(x, chr(9) || ' ') <> ''", "")


@query("src11_stripped_lines", ORACLES["src11_stripped_lines"])
def stripped_lines(spark, sf_dir):
    table(spark, sf_dir, "benchmark", "text").write.text(path := folder(spark, "lines"))
    return A.lines(spark, path, empty=True).groupBy(F.length("text").cast("long").alias("n")).agg(F.count("*").alias("c"))


@query("src05_corpus_column", "select lang, sum(length(text))::bigint as n from documents group by lang")
def corpus_column(spark, sf_dir):
    return A.corpus(spark, f"{sf_dir}/documents.parquet", "text", "lang").groupBy("lang").agg(F.sum(F.length("text")).alias("n"))


@query("src06_gold_segmentations", f"select distinct token as word, array_to_string({CHUNKS}, '|') as morphs from {BENCHMARK}")
def gold_segmentations(spark, sf_dir):
    rows = benchmark_words(spark, sf_dir).select("token").distinct().select("token", N.ngrams(3)(F.col("token")).alias("m")).collect()
    return A.gold(spark, [(r["token"], r["m"]) for r in rows]).select("word", F.array_join("morphs", "|").alias("morphs"))


@query("src07_named_table", f"select 'documents' as name, count(*)::bigint as known_size from documents")
def named_table(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").agg(F.lit("documents").alias("name"), F.count("*").alias("known_size"))


@query("src12_types_read_back", f"select type, rank from {VOCAB}")
def types_read_back(spark, sf_dir):
    A.write_types(benchmark_vocab(spark, sf_dir), path := folder(spark, "types"))
    return A.types(spark, path).select("type", F.col("rank").cast("long").alias("rank"))


ORACLES["snk01_types_as_text"] = f"select sum(length(type))::bigint as n, count(*)::bigint as types from {VOCAB}"


@query("snk01_types_as_text", ORACLES["snk01_types_as_text"])
def types_as_text(spark, sf_dir):
    A.write_types(benchmark_vocab(spark, sf_dir), path := folder(spark, "types"), text=True)
    return spark.read.text(path).agg(F.sum(F.length("value")).alias("n"), F.count("*").alias("types"))


def _merges(spark, sf_dir):
    """Pairs of the benchmark's words: their first two characters, in order."""
    pairs = benchmark_words(spark, sf_dir).where(F.length("token") >= 2).select(F.substring("token", 1, 2).alias("p")).distinct().orderBy("p").collect()
    return [(r["p"][0], r["p"][1]) for r in pairs]


PAIRS = f"(select p, (row_number() over (order by p) - 1)::bigint as k from (select distinct left(token, 2) as p from {BENCHMARK} where length(token) >= 2))"


@query("src13_merges_read_back", f"select k as priority, left(p, 1) || ' ' || right(p, 1) as parts from {PAIRS}")
def merges_read_back(spark, sf_dir):
    A.write_lines(spark, ["#version: 0.2", *(" ".join(m) for m in _merges(spark, sf_dir))], path := folder(spark, "merges"))
    file = [f for f in spark.read.text(path).inputFiles()][0]
    return A.merges(spark, file).select((F.col("priority") - 1).cast("long").alias("priority"), F.array_join("parts", " ").alias("parts"))


@query("snk02_merges_as_table", f"select k as priority, left(p, 1) || ' ' || right(p, 1) as parts from {PAIRS}")
def merges_as_table(spark, sf_dir):
    A.write_merges(spark, _merges(spark, sf_dir), path := folder(spark, "merges"))
    return spark.read.parquet(path).select(F.col("priority").cast("long").alias("priority"), F.array_join("parts", " ").alias("parts"))


@query("snk03_events_read_back", f"select k as event_id, k % 3 <> 0 as is_merge, left(p, 1) || ' ' || right(p, 1) as parts from {PAIRS}")
def events_read_back(spark, sf_dir):
    A.write_events(spark, [(i % 3 != 0, m) for i, m in enumerate(_merges(spark, sf_dir))], path := folder(spark, "events"))
    return A.events(spark, path).select(F.col("event_id").cast("long").alias("event_id"), "is_merge", F.array_join("parts", " ").alias("parts"))


ORACLES["src14_merge_events"] = f"select count(*) filter (k % 3 <> 0)::bigint as merges, count(*) filter (k % 3 = 0)::bigint as splits from {PAIRS}"


@query("src14_merge_events", ORACLES["src14_merge_events"])
def merge_events(spark, sf_dir):
    return events_read_back(spark, sf_dir).agg(F.count_if("is_merge").alias("merges"), F.count_if(~F.col("is_merge")).alias("splits"))


@query("snk04_ablated_read_back", f"select left(p, 1) || ' ' || right(p, 1) as parts, k % 5 = 0 as removed from {PAIRS}")
def ablated_read_back(spark, sf_dir):
    merges = _merges(spark, sf_dir)
    A.write_ablated(spark, merges, {"".join(m) for m in merges[::5]}, path := folder(spark, "ablated"))
    back, removed = A.ablated(spark, path)
    return spark.createDataFrame([(" ".join(m), "".join(m) in removed) for m in back], "parts string, removed boolean")


@query("src15_verbose_vocabulary", f"select type, rank as id from {VOCAB} where rank % 7 <> 0")
def verbose_vocabulary(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", F.struct(F.col("rank").alias("id"), (F.col("rank") % 7 == 0).alias("special"), F.lit(True).alias("present")).alias("e"))
    v.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("type", "e")))).alias("value")).write.text(path := folder(spark, "verbose"))
    return A.verbose_vocabulary(spark, path).select("type", "id")


@query("src16_likelihoods_read_back", f"select type, round(-(rank + 1) / 8.0, 6)::double as logp from {VOCAB}")
def likelihoods_read_back(spark, sf_dir):
    A.write_likelihoods(spark, {r["type"]: -(r["rank"] + 1) / 8 for r in benchmark_vocab(spark, sf_dir).collect()}, path := folder(spark, "likelihoods"))
    return A.likelihoods(spark, path).select("type", F.round("logp", 6).alias("logp"))


ORACLES["snk05_likelihoods_total"] = f"select count(*)::bigint as types, round(sum(-(rank + 1) / 8.0), 4)::double as total from {VOCAB}"


@query("snk05_likelihoods_total", ORACLES["snk05_likelihoods_total"])
def likelihoods_total(spark, sf_dir):
    return likelihoods_read_back(spark, sf_dir).agg(F.count("*").alias("types"), F.round(F.sum("logp"), 4).alias("total"))


@query("src17_sorted_word_list", f"select token as word, n as count from (select token, count(*)::bigint as n from {BENCHMARK} group by token)")
def sorted_word_list(spark, sf_dir):
    c = benchmark_words(spark, sf_dir).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("count"))
    A.write_word_list(c, path := folder(spark, "words"))
    return A.word_list(spark, path)


@query("snk06_row_as_json", "select r_regionkey::bigint as k, r_name as name from region")
def row_as_json(spark, sf_dir):
    A.write_metrics(table(spark, sf_dir, "region"), path := folder(spark, "metrics"))
    return spark.read.json(path).select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))


@query("snk07_cached_counter", "select lang, count(*)::bigint as n from documents group by lang")
def cached_counter(spark, sf_dir):
    compute = lambda: table(spark, sf_dir, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n"))
    root = folder(spark, "cache")
    A.cached(spark, root, "langs", {"by": "lang"}, compute)
    return A.cached(spark, root, "langs", {"by": "lang"}, lambda: None)  # the second time, what the first one wrote


@query("snk11_cached_by_parameters", "select source, count(*)::bigint as n from documents group by source")
def cached_by_parameters(spark, sf_dir):
    root = folder(spark, "cache")
    count = lambda c: (lambda: table(spark, sf_dir, "documents", c).groupBy(c).agg(F.count("*").alias("n")))
    A.cached(spark, root, "counts", {"by": "lang"}, count("lang"))
    return A.cached(spark, root, "counts", {"by": "source"}, count("source"))


SIDES = f"""(select 'right' as side, ws[i] as center, count(*)::bigint as n from (select ws, unnest(generate_series(1, len(ws))) as i from (select {WORDS} as ws from benchmark) where len(ws) > 0) group by 2
union all select 'left', ws[i], count(*)::bigint from (select ws, unnest(generate_series(1, len(ws))) as i from (select {WORDS} as ws from benchmark) where len(ws) > 0) group by 2)"""


@query("snk08_accessors_read_back", f"select side, center, n from {SIDES}")
def accessors_read_back(spark, sf_dir):
    from tessera.operators import accessors

    acc = accessors.accessors(table(spark, sf_dir, "benchmark", "text").withColumn("tokens", WS(F.col("text"))))
    A.write_table(acc, path := folder(spark, "accessors"), "side")
    return spark.read.parquet(path).groupBy("side", "center").agg(F.sum("n").cast("long").alias("n"))


@query("snk09_summaries_read_back", f"select side, count(*)::bigint as types, sum(n)::bigint as tokens from {SIDES} group by side")
def summaries_read_back(spark, sf_dir):
    from tessera.operators import accessors

    acc = accessors.accessors(table(spark, sf_dir, "benchmark", "text").withColumn("tokens", WS(F.col("text"))))
    A.write_summaries(accessors.summarise(acc), path := folder(spark, "summaries"))
    return spark.read.csv(path, header=True, inferSchema=True).groupBy("side").agg(F.count("*").alias("types"), F.sum("total").cast("long").alias("tokens"))


@query("snk10_confusion_read_back", "select (r_regionkey % 2)::bigint as k, count(*)::bigint as tp from region group by 1")
def confusion_read_back(spark, sf_dir):
    c = table(spark, sf_dir, "region").groupBy((F.col("r_regionkey") % 2).cast("long").alias("k")).agg(F.count("*").alias("tp"))
    A.write_table(c, path := folder(spark, "confusion"))
    return spark.read.parquet(path)


@query("snk13_appended_rows", "select r_name as name from region")
def appended_rows(spark, sf_dir):
    held = []
    from tessera.streaming.metrics import run_all

    run_all(table(spark, sf_dir, "region"), {"names": lambda b: b.select("r_name")}, lambda _, m: held.extend(m.collect()))
    return spark.createDataFrame([tuple(r) for r in held], "name string")


@query("snk18_vocabulary_json", f"select type, rank as id from {VOCAB}")
def vocabulary_json(spark, sf_dir):
    j = A.vocabulary_json(benchmark_vocab(spark, sf_dir).select("type", F.col("rank").alias("id")))
    return j.select(F.explode(F.from_json("json", "map<string, bigint>")).alias("type", "id"))


@query("snk20_path_safe", "select p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_.=-]', '_', 'g') as name from part")
def path_safe(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z0-9_.=-]", "_").alias("name"))


# Status of metrics that share a table.


@query("str03_status", "select * from (values ('count', 'finished'), ('first', 'ended early'), ('broken', 'failed: ZeroDivisionError')) t(metric, status)")
def metric_status(spark, sf_dir):
    from tessera.streaming.metrics import EarlyExit, run_all

    def enough(_):
        raise EarlyExit

    metrics = {"count": lambda b: b.agg(F.count("*")), "first": enough, "broken": lambda b: b.limit(1 // 0)}
    return spark.createDataFrame(A.status(run_all(table(spark, sf_dir, "region"), metrics, lambda _, m: m.collect())), "metric string, status string")


@query("str02_early_exit", "select count(*)::bigint as n from region")
def early_exit(spark, sf_dir):
    from tessera.streaming.metrics import EarlyExit, run_all

    def enough(_):
        raise EarlyExit

    held = []
    run_all(table(spark, sf_dir, "region"), {"a": enough, "b": lambda b: b.agg(F.count("*").alias("n"))}, lambda _, m: held.extend(m.collect()))
    return spark.createDataFrame([tuple(r) for r in held], "n long")


@query("str01_metric_graph", f"select lang, count(*)::bigint as tokens, count(distinct token)::bigint as types from {TOKENS} group by lang")
def metric_graph(spark, sf_dir):
    """Tokens once, two metrics over them, their results assembled."""
    t = words(spark, sf_dir, "lang").groupBy("lang", "token").agg(F.count("*").alias("n"))
    return t.groupBy("lang").agg(F.sum("n").alias("tokens")).join(t.groupBy("lang").agg(F.count("*").alias("types")), "lang")


@query("str05_split_and_recombined", f"select doc_id, len({WORDS})::bigint as a, ceil(length(text) / 3.0)::bigint as b from documents")
def split_and_recombined(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", WS(F.col("text")).alias("x"), N.ngrams(3)(F.col("text")).alias("y"))
    a, b = TK.unzipped(d, "doc_id", "x", "y")
    return TK.recombined([a.select("doc_id", F.size("x").cast("long").alias("a")), b.select("doc_id", F.size("y").cast("long").alias("b"))], "doc_id")


ORACLES["joi13_two_consumers"] = f"select sum(len({WORDS}))::bigint as a, sum(ceil(length(text) / 3.0))::bigint as b from documents"


@query("joi13_two_consumers", ORACLES["joi13_two_consumers"])
def two_consumers(spark, sf_dir):
    return split_and_recombined(spark, sf_dir).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("joi04_side_channel", f"select lang, source, count(*)::bigint as tokens from {TOKENS} group by lang, source")
def side_channel(spark, sf_dir):
    return words(spark, sf_dir, "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("tokens"))


# Filters, samples, order and frames.


@query("fil02_long_documents", "select doc_id from documents where length(text) > 2000")
def long_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").where(F.length("text") > 2000).select("doc_id")


@query("fil04_random_rows", "select doc_id, u < 0.1 as taken from (select doc_id, ('0x' || substr(md5('7:' || doc_id), 1, 8))::bigint / 4294967296.0 as u from documents)")
def random_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id")
    taken, rest = (TK.bernoulli(d, "doc_id", 0.1, complement, 7).withColumn("taken", F.lit(not complement)) for complement in (False, True))
    return taken.unionByName(rest)


@query("fil12_has_type", f"select token, token in (select type from {VOCAB}) as known, true as anything from (select distinct token from {TOKENS})")
def has_type(spark, sf_dir):
    t = V.known(words(spark, sf_dir).select("token").distinct(), benchmark_vocab(spark, sf_dir))
    return V.known(t.withColumnRenamed("known", "k"), None, infinite=True).select("token", F.col("k").alias("known"), F.col("known").alias("anything"))


@query("srt04_take_and_drop", "select doc_id, n_chars from documents order by doc_id limit 20 offset 10")
def take_and_drop(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return TK.drop(TK.take(d, 30, F.col("doc_id")), 10, F.col("doc_id"))


@query("srt06_types_by_id", f"select type, rank as place from {VOCAB}")
def types_by_id(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", (F.col("rank") * 2 + 5).alias("id"))
    return W.global_rank(v, F.col("id"), out="place").select("type", "place")


@query("srt08_most_common", f"select token, n from (select token, count(*)::bigint as n from {BENCHMARK} group by token) order by n desc, token limit 50")
def most_common(spark, sf_dir):
    c = benchmark_words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return TK.take(c, 50, F.desc("n"), F.col("token"))


@query("win10_frames", """select event_id, ntile(4) over w as quarter, round(percent_rank() over w, 6) as share, nth_value(event_type, 2) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as second,
    count(*) over (partition by user_id order by event_id range between 500 preceding and current row)::bigint as near from events window w as (partition by user_id order by event_id)""")
def frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select("event_id", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"), F.nth_value("event_type", 2).over(whole).alias("second"), F.count("*").over(w.rangeBetween(-500, 0)).alias("near"))


@query("agg30_laps", f"select count(*)::bigint as words, 2::bigint as laps from (select distinct token from {TOKENS})")
def laps(spark, sf_dir):
    n, took = TK.seconds_per_row(words(spark, sf_dir).select("token").distinct().select(N.ngrams(3)(F.col("token")).alias("t")), 2)
    return spark.createDataFrame([(n, sum(t > 0 for t in took))], "words long, laps long")


@query("agg32_bucket_average", """select user_id, round(sum(f * w) / sum(w), 6) as average, sum(w)::bigint as n from (select user_id, bucket, count(distinct event_type)::double as f, count(*) as w from (
    select user_id, event_type, (row_number() over (partition by user_id order by event_id) - 1) // 5 as bucket from events) group by user_id, bucket) group by user_id""")
def bucket_average(spark, sf_dir):
    b = W.buckets(table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", 5)
    return G.bucket_average(b, ["user_id"], "bucket", F.countDistinct("event_type")).select("user_id", F.round("average", 6).alias("average"), "n")


@query("joi06_gold_splits", f"with g as (select distinct token from {BENCHMARK}) select token, case when token in (select token from g) then array_to_string(list_transform(range(1, len({CHUNKS})), lambda i: 3 * i), ',') else '' end as cuts from (select distinct token from {TOKENS})")
def gold_splits(spark, sf_dir):
    """Gold cuts of the words that have some, moved by the length of the mark at their start."""
    gold = benchmark_words(spark, sf_dir).select("token").distinct().select("token", C.split_positions(N.ngrams(3)(F.col("token"))).alias("cuts"))
    t = words(spark, sf_dir).select("token").distinct().join(gold, "token", "left")
    moved = F.transform("cuts", lambda i: i - 1 + F.lit(len(T.ROBERTA.substitute)))
    return t.select("token", F.coalesce(F.array_join(moved, ","), F.lit("")).alias("cuts"))


# Vocabularies and wrappers.

FLAT = f"(select type, rank + 2 as id from {VOCAB} union all select '<s>', 0 union all select '<unk>', 1)"


@query("wrp13_split_flat_vocabulary", f"select type, rank + 2 as id, 0::bigint as bos, 1::bigint as unk from {VOCAB}")
def split_flat_vocabulary(spark, sf_dir):
    extra = spark.createDataFrame([("<s>", 0), ("<unk>", 1)], "type string, id long")
    flat = benchmark_vocab(spark, sf_dir).select("type", (F.col("rank") + 2).alias("id")).unionByName(extra)
    types, specials, unk = V.split_flat(flat, {"BOS": "<s>"}, "<unk>")
    return types.select("type", "id", F.lit(specials["BOS"]).cast("long").alias("bos"), F.lit(unk).cast("long").alias("unk"))


@query("wrp12_added_and_popped", f"with v as (select type, rank from {VOCAB} where type not in ('the', 'of')), n as (select count(*) as n from v) select type, (row_number() over (order by rank) - 1)::bigint as id from (select type, rank from v union all select '<new1>', 10000000 union all select '<new2>', 10000001)")
def added_and_popped(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", F.col("rank").alias("id"))
    return V.popped(V.added(v, ["<new1>", "<new2>", "the"]), ["the", "of"])


@query("wrp12_special_ranges", "select * from (values (0::bigint, 2::bigint), (7, 7), (9, 10)) t(low, high)")
def special_ranges(spark, sf_dir):
    return V.special_ranges(spark.createDataFrame([(i,) for i in (10, 0, 2, 1, 7, 9)], "id long"))


@query("wrp01_multiplexed", f"select doc_id, (case when doc_id % 2 = 0 then len({WORDS}) else ceil(length(text) / 6.0) end)::bigint as n from documents")
def multiplexed(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(V.multiplexed(F.col("doc_id") % 2, WS(F.col("text")), N.ngrams(6)(F.col("text")))).cast("long").alias("n"))


@query("wrp03_periodic", f"select doc_id, list_sum(list_transform({WORDS}, lambda w, i: case when ((i - 1) // 3) % 2 = 0 then 1 else ceil(length(w) / 2.0) end))::bigint as n from documents where len({WORDS}) > 0")
def periodic(spark, sf_dir):
    t = W.periodic(words(spark, sf_dir), "pos", 3, 2)
    return t.groupBy("doc_id").agg(F.sum(F.when(F.col("choice") == 0, 1).otherwise(F.size(N.ngrams(2)(F.col("token"))))).cast("long").alias("n"))


@query("wrp06_succession", "select doc_id, md5(array_to_string(list_transform(range(0, cast(ceil(length(text) / 8.0) as bigint)), lambda i: substr(text, 8 * i + 1, 8)), chr(1))) as h from documents")
def succession(spark, sf_dir):
    """Four characters each, then every two tokens joined."""
    run = V.succession(N.ngrams(4), V.joined_in(2))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(F.array_join(run(F.col("text")), "\x01").cast("binary")).alias("h"))


@query("fac01_tokeniser_by_name", f"select doc_id, sum(ceil(length(token) / 3.0))::bigint as n from {TOKENS} group by doc_id")
def tokeniser_by_name(spark, sf_dir):
    tk = P.tokeniser("ngrams", P.Preprocessor(splitter=WS), n=3)
    return tk.tokens(table(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("map40_undone", "select doc_id, md5(text) as h from documents")
def undone(spark, sf_dir):
    p = P.Preprocessor(reversible=T.compose_invertible(T.replace(" ", "▁"), T.append_space()), splitter=S.isolate_digits)
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(p.undo(p.do(F.col("text"))).cast("binary")).alias("h"))


@query("map41_alphabet", "select c, (i - 1)::bigint as id from (select unnest([" + ", ".join("'" + c.replace("'", "''") + "'" for c in P.PSEUDO_BYTES) + "]) as c, unnest(range(1, 257)) as i)")
def alphabet(spark, sf_dir):
    signs = P.alphabet_of(P.Preprocessor(), P.Preprocessor(reversible=B.pseudo_bytes(), alphabet=P.PSEUDO_BYTES), P.Preprocessor())
    return spark.createDataFrame([(c, i) for i, c in enumerate(signs)], "c string, id long")


@query("map15_mandatory_alphabet", "select chr(i::int) as c from range(32, 127) t(i)")
def mandatory_alphabet(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in T.alphabet("ascii")], "c string")


@query("map36_function", f"select doc_id, length(text)::bigint * 2 as n from documents")
def function(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", (F.length("text") * 2).cast("long").alias("n"))


@query("map28_gobble", "select doc_id, md5(x) as h, length(x)::bigint as n from (select doc_id, case when ('0x' || substr(md5('0:' || doc_id), 1, 8))::bigint / 4294967296.0 < 0.5 then '' else text end as x from documents)")
def gobbled(spark, sf_dir):
    from tessera.functions.perturb import gobble

    x = gobble(0.5, "doc_id")(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(x.cast("binary")).alias("h"), F.length(x).cast("long").alias("n"))


ORACLES["wrp05_stochastic_switch"] = f"select doc_id, (case when ('0x' || substr(md5('0:' || doc_id), 1, 8))::bigint / 4294967296.0 < 0.5 then len({WORDS}) else ceil(length(text) / 6.0) end)::bigint as n from documents"


# Strings and numbers.


@query("scl03_framed", "select p_partkey, repeat('#', length(p_name) + 4) || chr(10) || '# ' || p_name || ' #' || chr(10) || repeat('#', length(p_name) + 4) as f, '        ' || p_name || chr(10) || '        x' as i from part")
def framed(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    return p.select("p_partkey", C.framed(F.col("p_name")).alias("f"), C.indented(F.concat("p_name", F.lit("\nx")), 2).alias("i"))


@query("scl05_disambiguated", "select doc_id, source || case when k > 1 then '_' || k else '' end as name from (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents)")
def disambiguated(spark, sf_dir):
    return C.disambiguated(table(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id").select("doc_id", "name")


@query("scl08_byte_tokens", f"select token, '20' || hex(encode(token)) as b, true as back from (select distinct token from {TOKENS})")
def byte_tokens(spark, sf_dir):
    pseudo = F.concat(F.lit("Ġ"), B.pseudo_bytes()(F.col("token")))
    t = words(spark, sf_dir).select("token").distinct().withColumn("p", pseudo).withColumn("b", B.token_to_bytes(F.col("p"), B.pseudo_table(), T.ROBERTA))
    return t.select("token", F.hex("b").alias("b"), (B.bytes_to_token(F.col("b"), B.pseudo_table(), T.ROBERTA) == F.col("p")).alias("back"))


@query("scl24_length_ordered_keys", "select n::bigint as n, pow(2, n - 1)::bigint as keys, 0::bigint as least, (pow(2, n - 1) - 1)::bigint as most from range(1, 11) t(n)")
def length_ordered_keys(spark, sf_dir):
    keys = [(n, C.loc_key(c)) for n in range(1, 11) for c in C.compositions(n)]
    return spark.createDataFrame(keys, "n long, k long").groupBy("n").agg(F.countDistinct("k").alias("keys"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("scl25_compositions", "with recursive r(rest, s) as (select 9, '' union all select (rest - k)::int, s || k || ',' from r, range(1, 10) t(k) where k <= rest) select s from r where rest = 0")
def compositions(spark, sf_dir):
    return spark.createDataFrame([("".join(f"{k}," for k in c),) for c in C.compositions(9)], "s string")


@query("scl26_multiset_permutations", "with recursive r(s, k, a, b, c) as (select '', 0, 3, 2, 1 union all select s || x, k + 1, a - (x = 'a')::int, b - (x = 'b')::int, c - (x = 'c')::int from r, (values ('a'), ('b'), ('c')) t(x) where case x when 'a' then a when 'b' then b else c end > 0) select s, (row_number() over (order by s) - 1)::bigint as id, 60::bigint as total from r where k = 6")
def multiset_permutations(spark, sf_dir):
    from itertools import permutations

    return spark.createDataFrame([("".join(p), C.permutation_rank(p), C.multiset_permutations(p)) for p in sorted(set(permutations("aaabbc")))], "s string, id long, total long")


@query("scl30_formatted", """select o_orderkey, format('{:t }', o_orderkey * 1000) as thousands, case when o_orderkey % 10 = 1 then '1 order' else (o_orderkey % 10) || ' orders' end as plural,
    (o_orderkey % 5) || case o_orderkey % 5 when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end as nth, '+' || o_orderkey as sign, o_orderkey || (case when o_orderkey > 1000 then ' > ' when o_orderkey = 1000 then ' = ' else ' < ' end) || '1000' as compared from orders""")
def formatted(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey").select(
        "o_orderkey", C.separated_thousands(k * 1000).alias("thousands"), C.pluralised(k % 10, "order").alias("plural"), C.ordinal(k % 5).alias("nth"), C.signed(k).alias("sign"), C.compared(k, F.lit(1000)).alias("compared"),
    )


@query("scl42_nested_path", "select conv_id, turn, role || '!' as r from conversations")
def nested_path(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("s", F.struct(F.struct(F.col("role").alias("role")).alias("who")))
    return c.withColumn("s", C.with_path(F.col("s"), "who.role", F.concat("role", F.lit("!")))).select("conv_id", "turn", C.at_path(F.col("s"), "who.role").alias("r"))


@query("scl43_struct_to_map", "select doc_id, ((quality is not null)::int + (toxic is not null)::int)::bigint as n from labels")
def struct_to_map(spark, sf_dir):
    d = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumn("s", F.struct("quality", "toxic"))
    return d.select("doc_id", F.size(C.struct_to_map(F.col("s"), ["quality", "toxic"])).cast("long").alias("n"))


@query("scl45_piped", "select p_partkey, upper(reverse(p_name)) as x from part")
def piped(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", C.pipe(F.reverse, F.upper)(F.col("p_name")).alias("x"))
