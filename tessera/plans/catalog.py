"""Registered queries over the library's operators, with the SQL that gives the same rows.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import distribution as D
from tessera.operators import tokens as TK
from tessera.operators import windows as W
from tessera.functions import splitters as S
from tessera.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    import os

    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):  # Python workers import this package by name
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if {"text", "html"} & set(df.columns) else df


#: ASCII white space, which both engines read alike.
WS = S.on_regex(r"[ \n\t\r]+")
WORDS = "list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')"
TOKENS = f"(select doc_id, lang, source, unnest({WORDS}) as token from documents)"


def words(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return TK.pretokens(table(spark, sf_dir, "documents", *dict.fromkeys(["doc_id", *keep, "text"])), WS, keep=tuple(dict.fromkeys(["doc_id", *keep])))


_MATTR = f"""
with w as (select doc_id, lang, {WORDS} as ws from documents),
d as (select doc_id, lang, ws, coalesce(sum(len(ws)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as base from w),
t as (select lang, unnest(ws) as token, base + unnest(generate_series(0, len(ws) - 1)) as p from d where len(ws) > 0),
n as (select lang, max(p) + 1 as n from t group by lang),
f as (select lang, n, case when n >= 2000 then (n - 2000) // 1000 + 1 else 0 end as full_n from n),
k as (select lang, token, unnest(generate_series(greatest(0, cast(ceil((p - 1999) / 1000.0) as bigint)), cast(p // 1000 as bigint))) as k from t),
c as (select lang, k, count(distinct token) as types, count(*) as c from k group by lang, k),
u as (select c.lang, types, c, k < full_n as is_full, (k = full_n and not (full_n > 0 and c = 1000)) as is_rest from c join f using (lang))
select lang, sum(case when is_full or is_rest then 1 else 0 end)::bigint as windows,
       round(sum(case when is_full or is_rest then types / 2000.0 end) / sum(case when is_full then 1.0 when is_rest then c / 2000.0 end), 6) as mattr
from u group by lang"""


def _mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    stream = TK.positions(docs, WS(F.col("text")), by=("lang",))
    m = W.mattr(stream, 2000, 1000, ("lang",))
    return m.select("lang", F.col("windows").cast("long").alias("windows"), F.round("mattr", 6).alias("mattr"))


query("win01_mattr_by_lang", _MATTR)(_mattr)


@query(
    "flagship_lang_diversity",
    f"""with c as (select lang, token, count(*) as n from {TOKENS} group by lang, token),
    s as (select lang, count(*) as types, sum(n) as tokens, log2(sum(pow(n, 2.5))) as l from c group by lang),
    m as ({_MATTR})
    select s.lang, types::bigint as types, tokens::bigint as tokens, round(types / tokens, 6) as ttr,
           round((l - 2.5 * log2(tokens)) / (1 - 2.5), 6) as entropy,
           round((l - 2.5 * log2(tokens)) / (1 - 2.5) / log2(least(types, tokens)), 6) as efficiency, mattr
    from s join m using (lang)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: type/token ratio, Rényi entropy and efficiency (alpha 2.5), moving-average type/token ratio."""
    h = D.renyi(D.unigram(words(spark, sf_dir, "lang"), ("lang",)), 2.5, ("lang",))
    h = h.withColumn("ttr", F.col("types") / F.col("tokens")).withColumn("efficiency", D.efficiency(F.col("entropy"), F.col("types"), F.col("tokens"))[1])
    out = h.join(_mattr(spark, sf_dir).select("lang", "mattr"), "lang")
    rounded = [F.round(c, 6).alias(c) for c in ("ttr", "entropy", "efficiency")]
    return out.select("lang", F.col("types").cast("long").alias("types"), F.col("tokens").cast("long").alias("tokens"), *rounded, "mattr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import extra, further, metrics, models, more, texts  # noqa: F401 - they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from tessera.plans import sql  # noqa: F401 - longer ones
    return dict(ORACLES)
