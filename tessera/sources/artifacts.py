"""Sources and sinks: word lists, vocabularies, merges, event logs, likelihoods, metrics, and a load-or-compute cache.

Tables are written as Parquet with an explicit rank, so that order never depends on files or partitions; the text forms are
for exchange with other tools.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.regexes import SPACE, java
from tessera.session import set_checkpoints


def checkpoint(df: DataFrame) -> DataFrame:
    """Through files in the cluster's shared spark.checkpoint.dir."""
    set_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def corpus(spark: SparkSession, path: str, text: str = "text", *keep: str, fmt: str = "parquet") -> DataFrame:
    """Only the columns that are asked for: pruning reaches the scan."""
    return spark.read.format(fmt).load(path).select(*keep, text)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word<TAB>count lines; NUL stands for a tab or line break in the word. (The CSV reader would take NUL for its quote.)"""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("word"), parts[1].cast("long").alias("count"))


def write_word_list(df: DataFrame, path: str, ordered: bool = True) -> None:
    out = df.orderBy(F.desc("count"), "word") if ordered else df
    word = F.regexp_replace("word", "[\\t\\r\\n]", "\0")
    out.select(F.concat(word, F.lit("\t"), F.col("count").cast("string")).alias("value")).write.mode("overwrite").text(path)


def from_counter(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "word string, count long")


def gold(spark: SparkSession, rows: list[tuple[str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(rows, "word string, morphs array<string>")


def with_gold_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    return df.join(weights.select("word", "weight"), "word", "left").fillna(1.0, ["weight"])


def lines(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    stripped = spark.read.text(path).select(F.regexp_replace("value", java(rf"\A{SPACE}+|{SPACE}+\z"), "").alias("text"))
    return stripped if empty else stripped.where("text <> ''")


def _ranked_lines(spark: SparkSession, path: str) -> DataFrame:
    """A small ordered text file: read whole, so that the rank is the line's number."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rank", "line"))


def types(spark: SparkSession, path: str) -> DataFrame:
    if os.path.isdir(path):
        return spark.read.parquet(path)
    return _ranked_lines(spark, path).where("line <> ''").select("rank", F.translate("line", "\x05\x06", "\n\r").alias("type"))


def write_types(df: DataFrame, path: str, text: bool = False) -> None:
    if text:
        df.orderBy("rank").select(F.translate("type", "\n\r", "\x05\x06").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").parquet(path)


def merges(spark: SparkSession, path: str) -> DataFrame:
    return _ranked_lines(spark, path).where("line <> '' and not startswith(line, '#version')").select(F.col("rank").alias("priority"), F.split("line", " ").alias("parts"))


def write_merges(spark: SparkSession, rows: list[tuple[str, ...]], path: str) -> None:
    spark.createDataFrame([(i, list(m)) for i, m in enumerate(rows)], "priority int, parts array<string>").write.mode("overwrite").parquet(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """`+ a b` and `- a b` lines."""
    parts = F.split("line", " ")
    return _ranked_lines(spark, path).where("line <> ''").select(F.col("rank").alias("event_id"), (parts[0] == "+").alias("is_merge"), F.slice(parts, 2, F.size(parts)).alias("parts"))


def verbose_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of type → {id, special, present, ...}; those present and not special."""
    entry = F.from_json("value", "map<string, struct<id: long, special: boolean, present: boolean>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(entry).alias("type", "e"))
    return rows.select("type", "e.*").where("coalesce(present, true) and not coalesce(special, false)")


def likelihoods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="type string, logp double", quote="", escape="")


def json_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_summaries(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("side").csv(path, header=True)


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy().agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "id"))))).alias("json"))


def cached(spark: SparkSession, root: str, name: str, parameters: object, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table of an earlier run with the same name and parameters, else computed and written. A run that broke off leaves no
    _SUCCESS and is done again."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=repr).encode()).hexdigest()[:10]
    path = f"{root.rstrip('/')}/{name}_{key}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def assemble(metrics: list[tuple[str, DataFrame]]) -> DataFrame:
    """One wide row of several one-row metrics, their columns suffixed."""
    out = None
    for suffix, m in metrics:
        m = m.withColumnsRenamed({c: f"{c}_{suffix}" for c in m.columns})
        out = m if out is None else out.crossJoin(m)
    return out


def path_safe(name: str) -> str:
    """A name that any file system takes: other signs become underscores."""
    return "".join(c if c.isalnum() or c in "-_.=" else "_" for c in name)


def write_lines(spark: SparkSession, rows: list[str], path: str) -> None:
    """Few lines, in order, in one file."""
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_events(spark: SparkSession, log: list[tuple[bool, tuple[str, ...]]], path: str) -> None:
    """The log of a trainer that also splits, one event a line, as `events` reads it."""
    write_lines(spark, [f"{'+' if is_merge else '-'} {' '.join(parts)}" for is_merge, parts in log], path)


def write_likelihoods(spark: SparkSession, logp: dict[str, float], path: str) -> None:
    """type<TAB>log probability, as `likelihoods` reads it."""
    write_lines(spark, [f"{t}\t{p!r}" for t, p in sorted(logp.items())], path)


def write_ablated(spark: SparkSession, merges: list[tuple[str, ...]], removed: set[str], path: str) -> None:
    """Merges of which some types are taken out again: the merges, and the types, each by itself."""
    write_merges(spark, merges, f"{path}/merges")
    spark.createDataFrame([(t,) for t in sorted(removed)], "type string").write.mode("overwrite").parquet(f"{path}/removed")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ablated(spark: SparkSession, path: str) -> tuple[list[tuple[str, ...]], set[str]]:
    if not (exists(spark, f"{path}/merges/_SUCCESS") and exists(spark, f"{path}/removed/_SUCCESS")):
        raise FileNotFoundError(path)
    rows = spark.read.parquet(f"{path}/merges").orderBy("priority").collect()
    return [tuple(r["parts"]) for r in rows], {r[0] for r in spark.read.parquet(f"{path}/removed").collect()}


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Accessors, confusion counts, summaries: Parquet, by side or another small key, without gathering it."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def status(results: dict[str, str | None]) -> list[tuple[str, str]]:
    """(metric, what became of it): finished, ended early, or failed with an error."""
    return [(name, "finished" if error is None else "ended early" if error == "early exit" else f"failed: {error}") for name, error in results.items()]
