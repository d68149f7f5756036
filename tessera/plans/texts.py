"""Queries over sources, mappers, splitters, filters, scalars and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytes as B
from tessera.functions import perturb as P
from tessera.functions import scalars as C
from tessera.functions import splitters as S
from tessera.functions import text as T
from tessera.operators import tokens as TK
from tessera.operators import vocab as V
from tessera.operators import windows as W
from tessera.operators.segment import native as N
from tessera.plans import prefabs
from tessera.plans.catalog import TOKENS, WORDS, WS, query, table, words


def mapped(name, mapper, sql, source="documents", key="doc_id", text="text"):
    """A mapper over a whole table; results are compared by hash, which keeps the rows small."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source, key, text).select(F.col(key).cast("long").alias(key), F.md5(mapper(F.col(text)).cast("binary")).alias("h"), F.length(mapper(F.col(text))).cast("long").alias("n"))

    query(name, sql and f"select {key}, md5(x) as h, length(x)::bigint as n from (select {key}, {sql} as x from {source})")(run)


def split(name, splitter, sql, source="documents", key="doc_id", text="text"):
    """A splitter over a whole table: pieces joined by U+0001, by hash, and their number."""

    def run(spark, sf_dir):
        s = table(spark, sf_dir, source, key, text).withColumn("x", splitter(F.col(text)))
        return s.select(key, F.md5(F.array_join("x", "\x01").cast("binary")).alias("h"), F.size("x").cast("long").alias("n"))

    query(name, sql and f"select {key}, md5(array_to_string(x, chr(1))) as h, len(x)::bigint as n from (select {key}, {sql} as x from {source})")(run)


mapped("map01_compose", T.compose(T.lower, T.truncate(200), T.filter_characters("aeiou")), "translate(left(lower(text), 200), 'aeiou', '')")
mapped("map02_invertible", lambda c: (m := T.compose_invertible(T.replace(" ", "▁"), T.append_space())).invert(m(c)), "text")
mapped("map03_identity", T.identity, "text")
mapped("map04_strip", T.strip, "trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(8239) || chr(12288))")
mapped("map05_lower", T.lower, "lower(text)")
mapped("map06_truncate", T.truncate(100), "left(text, 100)")
mapped(
    "map07_truncate_at_blank", T.truncate_at_blank(300, 50),
    "case when length(text) <= 300 then text when strpos(reverse(substr(text, 250, 51)), ' ') > 0 then left(text, 300 - strpos(reverse(substr(text, 250, 51)), ' ')) else left(text, 300) end",
)
mapped("map08_filter_regex", T.filter_regex("[0-9]+", "#"), "regexp_replace(text, '[0-9]+', '#', 'g')")
mapped("map09_filter_characters", T.filter_characters(".,!?"), "translate(text, '.,!?', '')")
mapped("map10_filter_whitespace", T.filter_whitespace, "regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}\\x{1c}-\\x{1f}\\p{Z}]', '', 'g')")
mapped("map11_filter_hyperlinks", T.filter_hyperlinks, "regexp_replace(html, '" + T.HYPERLINK + "', '', 'g')", "pages", "page_id", "html")
mapped("map12_swallow", T.swallow_if_contains(r"[$%&]{3}"), "case when regexp_matches(text, '[$%&]{3}') then '' else text end")
mapped("map13_limit_repetitions", T.limit_repetitions(2), None)
mapped("map14_dilate", T.dilate(WS), f"array_to_string({WORDS}, ' ')")
mapped("map18_append_space", T.append_space(), "' ' || text")
mapped("map19_replace", T.replace("the", "THE"), "replace(text, 'the', 'THE')")
mapped("map20_replace_boundary", T.replace_boundary(" ", T.KUDO), "case when starts_with(text, ' ') then '▁' || substr(text, 2) else text end")
mapped("map21_turkish_capitals", T.turkish_capitals, "translate(text, 'çıöüşğ', 'CIOUSG')")
mapped("map22_pseudo_bytes", B.pseudo_bytes(), None)
mapped("map23_pseudo_bytes_inverse", lambda c: B.pseudo_bytes().invert(B.pseudo_bytes()(c)), "text")
mapped("map24_latin_bytes_inverse", lambda c: B.latin_bytes().invert(B.latin_bytes()(c)), "text")
mapped("map25_nfkc", T.normalise(), None)
mapped("map26_truncate_and_normalise", T.truncate_and_normalise(500), None)
mapped("map29_fixed_truncate", P.fixed_truncate(5, 7), "substr(text, 6, greatest(0, length(text) - 12))")
mapped("map31_pop", P.pop(0.5, 0.1), None)
mapped("map32_insert", P.insert(0.5, 0.1), None)
mapped("map33_substitute", P.substitute(0.5, 0.1), None)
mapped("map34_keyboard_typos", P.keyboard_typos(0.5, 0.1), None)
mapped("map35_series", P.series(P.pop(0.5, 0.1), P.insert(0.5, 0.1)), None)

split("spl01_sequence", S.sequence(WS, S.isolate_digits), None)
split("spl02_whole", S.whole, "[text]")
split("spl04_punctuation_excluded", S.isolate_punctuation("excluded"), None)
split("spl04_punctuation_unprotected", S.isolate_punctuation("included", False), None)
split("spl04_punctuation_grouped", S.isolate_punctuation("included", True, T.Side.START), None)
split("spl05_group_distinct_punctuation", S.sequence(S.isolate_punctuation("included", False), S.group_distinct_punctuation), None)
split("spl06_whitespace_marked", S.on_whitespace_marked(T.KUDO), "list_transform(" + WORDS + ", lambda w, i: case when i > 1 or regexp_matches(text, '^[ \\n\\t\\r]') then '▁' || w else w end)")
split("spl07_on_regex", S.on_regex("[.!?]+"), "list_filter(string_split_regex(text, '[.!?]+'), lambda x: x <> '')")
split("spl07_on_regex_kept", S.on_regex("[0-9]+", False), "list_filter(string_split(regexp_replace(text, '([0-9]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')")
split("spl08_regex_groups", S.into_regex_groups("[A-Za-z]+"), "regexp_extract_all(text, '[A-Za-z]+')")
split("spl09_whitespace", WS, WORDS)
split("spl10_space_prefixed", S.into_space_prefixed(), None)
split("spl12_numbers", S.isolate_numbers, None)
split("spl13_digits", S.isolate_digits, "list_filter(string_split(regexp_replace(text, '(\\p{N})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')")
split("spl14_group_digits", S.group_digits(3), None)
split("spl15_connecting_hyphens", S.isolate_connecting_hyphens, None)
split("spl16_polarise_apostrophes", S.sequence(WS, S.polarise_apostrophes()), None)
split("spl17_contractions", S.sequence(WS, S.isolate_contractions()), None)
split("spl20_word_boundary", S.sequence(WS, S.add_word_boundary(T.SENNRICH)), f"list_transform({WORDS}, lambda w: w || '</w>')")
split("spl21_capital_marker", S.sequence(WS, S.add_capital_marker()), None)
split("spl23_mapper_as_splitter", S.sequence(WS, S.mapped(T.lower)), f"list_transform({WORDS}, lambda w: lower(w))")
split("spl24_insert_reverse", S.insert_reverse, "[text, reverse(text)]")
split("spl26_kudo_words", lambda c: S.kudo_words()(F.replace(c, F.lit(" "), F.lit("▁"))), None)
split("spl27_unsplit", lambda c: F.array(S.unsplit(S.isolate_digits(c))), "[text]")
for _name in ("traditional", "modern_english", "prefab2", "roberta", "sentencepiece"):
    split(f"spl28_{_name}", prefabs.prefab(_name), None)
split("tok37_ngrams", N.ngrams(3), "list_transform(range(0, cast(ceil(length(text) / 3.0) as bigint)), lambda i: substr(text, 3 * i + 1, 3))")
split("tok38_strided_ngrams", N.strided_ngrams(5, 2), "list_transform(range(0, cast(greatest(0, ceil((length(text) - 5) / 2.0)) as bigint) + 1), lambda i: substr(text, 2 * i + 1, 5))")
split("tok39_characters", N.characters, "list_filter(string_split(text, ''), lambda x: x <> '')")


@query("tok39_code_points", f"select token, list_aggregate(list_transform(list_filter(string_split(token, ''), lambda x: x <> ''), lambda x: unicode(x)::bigint), 'sum')::bigint as total from (select distinct token from {TOKENS})")
def code_points(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct()
    return t.select("token", F.aggregate(N.code_points(F.col("token")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("src08_weighted", "select d.doc_id, coalesce(l.quality, 1)::double as weight from documents d left join labels l using (doc_id)")
def weighted(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return TK.weighted(d, "quality").select("doc_id", F.col("weight").cast("double").alias("weight"))


@query("src09_repeated", "select item_id, i::int as copy from benchmark, unnest(generate_series(0, 4)) t(i)")
def repeated(spark, sf_dir):
    return TK.repeated(table(spark, sf_dir, "benchmark", "item_id"), 5).select("item_id", "copy")


@query("src10_gold_weights", f"select t.token as word, coalesce(b.n, 1.0)::double as weight from (select distinct token from {TOKENS}) t left join (select unnest({WORDS}) as token, count(*)::double as n from benchmark group by 1) b using (token)")
def gold_weights(spark, sf_dir):
    from tessera.sources.artifacts import with_gold_weights

    weights = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).groupBy(F.col("token").alias("word")).agg(F.count("*").cast("double").alias("weight"))
    return with_gold_weights(words(spark, sf_dir).select(F.col("token").alias("word")).distinct(), weights)


@query("src19_character_counts", "select c, count(*)::bigint as n from (select unnest(list_filter(string_split(text, ''), lambda x: x <> '')) as c from documents) group by c")
def character_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents", "text").select(F.explode(N.characters(F.col("text"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("snk16_any_token_of", f"select doc_id from (select doc_id, {WORDS} as ws from documents) where list_has_any(ws, ['the', 'de', 'der'])")
def any_token(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("ws", WS(F.col("text")))
    return TK.any_token_of(d, "ws", ["the", "de", "der"]).select("doc_id")


@query("snk17_json_rows", "select conv_id, turn, length(text)::bigint as n from conversations")
def json_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("j"))
    return c.select(F.from_json("j", "conv_id long, turn long, text string").alias("r")).select("r.conv_id", "r.turn", F.length("r.text").cast("long").alias("n"))


@query("src20_event_props", "select event_type, sum((props->>'$.k')::bigint)::bigint as k, count(*)::bigint as n from events group by event_type")
def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "props")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("map38_atomise", f"select token, array_to_string(list_filter(string_split(left(token, -1), ''), lambda x: x <> ''), '|') || (case when length(token) > 1 then '|' else '' end) || right(token, 1) || '</w>' as atoms from (select distinct token from {TOKENS})")
def atomise(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct()
    return t.select("token", F.array_join(T.SENNRICH.atomise(F.concat("token", F.lit("</w>"))), "|").alias("atoms"))


@query(
    "map39_boundary_marker",
    f"""with t as (select distinct case when length(token) % 10 < 7 then '▁' || token else token end as type from {TOKENS}),
    c as (select 'start' as side, left(type, i::int) as mark from t, unnest(generate_series(1, 16)) g(i) where i <= length(type)
          union all select 'end', right(type, i::int) from t, unnest(generate_series(1, 16)) g(i) where i <= length(type)),
    s as (select side, mark, count(*) / (select count(*) from t)::double as share from c group by side, mark)
    select side, arg_max(mark, length(mark)) as mark, round(arg_max(share, length(mark)), 6) as share from s where share >= 0.5 group by side""",
)
def boundary_marker(spark, sf_dir):
    t = words(spark, sf_dir).select(F.when(F.length("token") % 10 < 7, F.concat(F.lit("▁"), "token")).otherwise(F.col("token")).alias("type")).distinct()
    return V.boundary_marker(t).select("side", "mark", F.round("share", 6).alias("share"))


@query("fil01_filter", "select doc_id, n_chars from documents where n_chars > 1000 and lang = 'en'")
def filtered(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang").where("n_chars > 1000 and lang = 'en'").select("doc_id", "n_chars")


@query("fil03_holdout", "select doc_id, (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100 < 80) as train from documents")
def holdout(spark, sf_dir):
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", (u < 80).alias("train"))


@query("fil05_non_null", "select d.doc_id from documents d left join labels l using (doc_id) where l.quality is not null")
def non_null(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return d.dropna(subset=["quality"]).select("doc_id")


@query("fil07_length_exclusion", f"select token, count(*)::bigint as n from {TOKENS} where length(token) <= 10 group by token")
def length_exclusion(spark, sf_dir):
    return words(spark, sf_dir).where(F.length("token") <= 10).groupBy("token").agg(F.count("*").alias("n"))


@query("fil09_frequency_minimum", f"select token, count(*)::bigint as n from {TOKENS} group by token having count(*) >= 5")
def frequency_minimum(spark, sf_dir):
    return words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n")).where("n >= 5")


VOCAB = f"(select token as type, (row_number() over (order by n desc, token) - 1)::bigint as rank from (select token, count(*) as n from {TOKENS.replace('documents', 'benchmark').replace('doc_id, lang, source, ', '')} group by token))"


def benchmark_vocab(spark, sf_dir):
    c = TK.explode_tokens(table(spark, sf_dir, "benchmark", "text"), WS(F.col("text"))).groupBy(F.col("token").alias("type")).agg(F.count("*").alias("n"))
    return W.global_rank(c, F.desc("n"), F.col("type")).select("type", "rank")


@query("wrp11_absolute_ids", f"select type, (rank + (case when rank >= 0 then 1 else 0 end) + (case when rank + 1 >= 5 then 1 else 0 end))::bigint as id from {VOCAB}")
def absolute_ids(spark, sf_dir):
    return V.absolute_ids(benchmark_vocab(spark, sf_dir), [0, 5])


@query("wrp11_relative_ids", f"select type, (rank + 3)::bigint as id from {VOCAB}")
def relative_ids(spark, sf_dir):
    return V.relative_ids(benchmark_vocab(spark, sf_dir), ["BOS", "EOS"], ["PAD"])[0]


@query("wrp10_compacted", f"select type, rank as id from {VOCAB}")
def compacted(spark, sf_dir):
    return V.compacted(benchmark_vocab(spark, sf_dir).select("type", (F.col("rank") * 3 + 7).alias("id")))


@query("wrp02_different_domains", f"select '0_' || type as type, rank as id from {VOCAB} union all select '1_' || type, rank + (select count(*) from {VOCAB}) from {VOCAB}")
def different_domains(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", F.col("rank").alias("id"))
    return V.combined([v, v], [v.count()] * 2)


@query("set06_byte_fallback", f"select type, rank as id from {VOCAB} union all select '[BYTE ' || i || ']', 1000000 + i from unnest(generate_series(0, 255)) t(i)")
def byte_fallback(spark, sf_dir):
    return V.with_bytes(benchmark_vocab(spark, sf_dir).select("type", F.col("rank").alias("id")), 1_000_000)


@query("joi01_ids_with_unk", f"select doc_id, sum(coalesce(v.rank + 1, 0))::bigint as s, count(*) filter (v.rank is null)::bigint as unks from {TOKENS} t left join {VOCAB} v on t.token = v.type group by doc_id")
def ids_with_unk(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", (F.col("rank") + 1).alias("id"))
    ids = V.to_ids(words(spark, sf_dir), v, 0)
    return ids.groupBy("doc_id").agg(F.sum("id").alias("s"), F.sum((F.col("id") == 0).cast("long")).alias("unks"))


@query("joi02_types_from_ids", f"select token, count(*)::bigint as n from (select case when v.type is null then '' else t.token end as token from {TOKENS} t left join {VOCAB} v on t.token = v.type) group by token")
def types_from_ids(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select("type", (F.col("rank") + 1).alias("id"))
    ids = V.to_ids(words(spark, sf_dir), v, 0).select("id")
    return V.from_ids(ids, v, [], 0).groupBy("token").agg(F.count("*").alias("n"))


@query("joi05_lookup", f"select t.token as pretoken, case when v.type is null then '' else t.token end as piece from (select distinct token from {TOKENS}) t left join {VOCAB} v on t.token = v.type")
def lookup(spark, sf_dir):
    known = benchmark_vocab(spark, sf_dir).select(F.col("type").alias("pretoken"), F.array("type").alias("tokens"))
    t = words(spark, sf_dir).select(F.col("token").alias("pretoken")).distinct()
    return N.looked_up(t, known).select("pretoken", F.array_join("tokens", "|").alias("piece"))


@query("joi09_semi_join", f"select count(*)::bigint as n from {TOKENS} where token in (select type from {VOCAB})")
def semi_join(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select(F.col("type").alias("token"))
    return words(spark, sf_dir).join(v, "token", "left_semi").agg(F.count("*").alias("n"))


@query("set03_anti_join", f"select distinct token from {TOKENS} where token not in (select type from {VOCAB})")
def anti_join(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select(F.col("type").alias("token"))
    return words(spark, sf_dir).select("token").distinct().join(v, "token", "left_anti")


@query("fil10_without_baked", f"select type from {VOCAB} where type not in ('the', 'of', '<s>')")
def without_baked(spark, sf_dir):
    return V.without_baked(benchmark_vocab(spark, sf_dir), ["the", "of", "<s>"]).select("type")


@query("wrp09_hashed_ids", f"with h as (select distinct token, ('0x' || substr(sha256(token), 1, 10))::bigint % 9998 as i from {TOKENS}), a as (select token, case when i >= 0 then i + 1 else i end as i from h) select token, (case when i >= 7 then i + 1 else i end)::bigint as id from a")
def hashed_ids(spark, sf_dir):
    return words(spark, sf_dir).select("token").distinct().select("token", V.hashed_id(F.col("token"), 10_000, [0, 7]).alias("id"))


@query("wrp14_template", f"select doc_id, array_to_string([1] || list_transform({WORDS}, lambda w: length(w)) || [2], ',') as ids from documents")
def templates(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    ids = V.named_template("bert", F.transform(WS(F.col("text")), F.length), {"CLS": 1, "SEP": 2})
    return d.select("doc_id", F.array_join(ids, ",").alias("ids"))


@query("wrp15_specials_mask", f"select doc_id, list_aggregate(list_transform(list_transform({WORDS}, lambda w: length(w)), lambda n: case when n in (1, 2) then 1 else 0 end), 'sum')::bigint as specials from documents where len({WORDS}) > 0")
def specials_mask(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("ids", F.transform(WS(F.col("text")), F.length)).where(F.size("ids") > 0)
    return d.select("doc_id", F.aggregate(V.specials_mask(F.col("ids"), [1, 2]), F.lit(0).cast("long"), lambda a, x: a + x).alias("specials"))


@query("wrp08_word_level_unk", f"with v as (select type from {VOCAB}), k as (select doc_id, count(*) as n, count(v.type) as known from {TOKENS} t left join v on t.token = v.type group by doc_id) select d.doc_id, (case when k.n is null then 0 when k.n = k.known then k.n else 1 end)::bigint as n from documents d left join k using (doc_id)")
def word_level_unk(spark, sf_dir):
    v = benchmark_vocab(spark, sf_dir).select(F.col("type").alias("token"), F.lit(True).alias("known"))
    ids = words(spark, sf_dir).join(v, "token", "left").groupBy("doc_id").agg(F.collect_list("token").alias("ts"), F.collect_list(F.coalesce("known", F.lit(False))).alias("ks"))
    both = table(spark, sf_dir, "documents", "doc_id").join(ids, "doc_id", "left")
    n = F.when(F.col("ts").isNotNull(), F.size(V.word_level_unk(F.col("ts"), F.col("ks")))).otherwise(0)  # no words, no tokens
    return both.select("doc_id", n.cast("long").alias("n"))


@query("wrp04_fewest", f"select doc_id, least(len({WORDS}), cast(ceil(length(text) / 6.0) as bigint))::bigint as n from documents")
def fewest(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(V.fewest(WS(F.col("text")), N.ngrams(6)(F.col("text")))).cast("long").alias("n"))


@query("wrp05_stochastic_switch")
def switch(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(V.drawn([0.5, 0.5], F.col("doc_id"), WS(F.col("text")), N.ngrams(6)(F.col("text")))).cast("long").alias("n"))


@query("scl01_shash", f"select token, substr(sha256(token), 1, 10) as h from (select distinct token from {TOKENS})")
def shash(spark, sf_dir):
    return words(spark, sf_dir).select("token").distinct().select("token", C.shash(F.col("token")).alias("h"))


@query("scl02_affixes", f"select token, '<' || token || '>' as c, token || '+' as s from (select distinct token from {TOKENS})")
def affixes(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct()
    return t.select("token", C.circumfix_if(F.col("token"), "<", ">").alias("c"), C.suffix_if(F.col("token"), "+").alias("s"))


@query("scl04_case", "select p_partkey, lower(replace(p_name, ' ', '_')) as snake, lower(replace(p_name, ' ', '-')) as kebab from part")
def cases(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    return p.select("p_partkey", C.convert_case(F.col("p_name"), "snake").alias("snake"), C.convert_case(F.col("p_name"), "kebab").alias("kebab"))


CHUNKS = "list_transform(range(0, cast(ceil(length(token) / 3.0) as bigint)), lambda i: substr(token, 3 * i + 1, 3))"


@query("scl07_isomorphs", f"select token, array_to_string(list_transform(range(0, len({CHUNKS})), lambda i: 3 * i), ',') as starts, list_aggregate(list_transform({CHUNKS}, lambda x: length(x)), 'max')::bigint as longest from (select distinct token from {TOKENS})")
def isomorphs(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct().withColumn("c", N.ngrams(3)(F.col("token")))
    return t.select("token", F.array_join(C.token_starts(F.col("c")), ",").alias("starts"), F.array_max(C.token_lengths(F.col("c"))).cast("long").alias("longest"))


@query("scl07_mask_round_trip", f"select token, {CHUNKS} = {CHUNKS} as same from (select distinct token from {TOKENS})")
def mask_round_trip(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct().withColumn("c", N.ngrams(3)(F.col("token")))
    return t.select("token", (C.from_mask(F.col("token"), C.token_mask(F.col("c"))) == F.col("c")).alias("same"))


@query("scl20_softmax", "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select vec_id, list_transform(v, lambda x: exp(x - list_max(v))) as e from e) select vec_id, round(list_max(e) / list_sum(e), 6) as top from s")
def softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(F.array_max(C.softmax(F.col("v"))), 6).alias("top"))


@query("scl22_probability_transforms", "select event_id, round(2 * p - 1, 6) as linear, round(case when p < 0.5 then -1 * (1 - 2 * p) else 2 * p - 1 end, 6) as piecewise, round(pow(p, 0.25), 6) as power, round(sin(p * pi() / 2), 6) as sine from (select event_id, (event_id % 101) / 100.0 as p from events)")
def transforms(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id").withColumn("p", (F.col("event_id") % 101) / 100.0)
    return e.select("event_id", *(F.round(C.PROBABILITY[k](F.col("p")), 6).alias(k) for k in ("linear", "piecewise", "power", "sine")))


@query("scl23_bit_key", f"select token, (list_aggregate(list_transform(range(1, length(token)), lambda i: case when i % 3 = 0 then pow(2, length(token) - 1 - i) else 0 end), 'sum'))::bigint as key from (select distinct token from {TOKENS} where length(token) between 2 and 40)")
def bit_keys(spark, sf_dir):
    t = words(spark, sf_dir).select("token").distinct().where(F.length("token").between(2, 40))
    return t.select("token", C.bit_key(C.token_lengths(N.ngrams(3)(F.col("token")))).alias("key"))


@query("scl27_schedules", "select event_id, round(10 + 90 * t, 6) as linear, round(10 + 90 * t * t, 6) as power, round(10 + 90 * (pow(2, t) - 1), 6) as exponential from (select event_id, (event_id % 101) / 100.0 as t from events)")
def schedules(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id").withColumn("t", (F.col("event_id") % 101) / 100.0)
    return e.select("event_id", *(F.round(C.schedule(k, F.col("t"), 10, 100), 6).alias(a) for k, a in (("identity", "linear"), ("power", "power"), ("exponential", "exponential"))))


@query("scl40_invert_map", "select r_regionkey::bigint as k, r_name as v from region")
def invert(spark, sf_dir):
    m = table(spark, sf_dir, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", "r_regionkey"))).alias("m"))
    return m.select(F.explode(C.invert_map(F.col("m"))).alias("k", "v")).select(F.col("k").cast("long").alias("k"), "v")


@query("scl44_index_span", f"select doc_id, (case when len({WORDS}) >= 3 then list_position({WORDS}, ({WORDS})[3]) - 1 end)::bigint as i from documents")
def index_span(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("w", WS(F.col("text")))
    return d.select("doc_id", F.when(F.size("w") >= 3, C.index_span(F.col("w"), F.slice("w", 3, 1))).cast("long").alias("i"))


@query("scl48_stamp", "select event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') as s from events")
def stamps(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", C.stamp(F.col("ts")).alias("s"))
