"""From raw documents to token ids: five stages, each a call of one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of documents. Rows: quality keeps what it scores 0.5 or more; simhash keeps the smallest doc_id of
each group of near-duplicates; repeats keeps every row, with texts (and n_chars) without what occurred earlier;
mix keeps every row, written in the order of the mixture; pieces returns each document's piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, pieces, quality, simhash, suffix
from tessera.llm.common import materialize, prepare, read, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(prepare(spark), sf_dir, "labels"))
    return docs.where(model.column(spark, F.col("text")) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(prepare(spark))
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(prepare(spark))
    return suffix.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(prepare(spark))
    names = ("__mixed_block", "__mixed_slot", "__mixed_position")
    mixed = mixing.mix(docs, out=names).repartitionByRange(names[2]).sortWithinPartitions(names[2])
    return mixed.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(prepare(spark))
    return pieces.encode(docs).select(F.col("id").alias("doc_id"), "n_bytes", F.size("ids").cast("long").alias("n_pieces"), "exact", "ids")


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: Fitting, near-duplicates and suffix order can't be written in SQL; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
