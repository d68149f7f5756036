"""Metrics over unbounded input with Structured Streaming.

Stateless operators (mappers, splitters, kernels) are ordinary columns on a streaming DataFrame. Totals are streaming
aggregations; the moving-average type/token ratio carries the tokens of unfinished windows over. `fan_out` tokenises a batch once
and feeds several metrics, of which one may fail without stopping the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.splitters import on_regex
from tessera.operators.tokens import positions
from tessera.operators.windows import window_types
from tessera.session import shared_folder

WS = on_regex(r"[ \n\t\r]+")
#: Groups of a stream whose positions are sent to all tasks; beyond, they are joined by a shuffle.
MANY = 100_000


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the Parquet files under a folder, or of the one file that the path names."""
    schema, path = spark.read.parquet(path).schema, path.rstrip("/")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile():
        folder, _, name = path.rpartition("/")
        return spark.readStream.schema(schema).options(pathGlobFilter=name, **options).parquet(folder)
    return spark.readStream.schema(schema).options(**options).parquet(path)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(WS(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; what is later than the watermark is left out, and state before it goes."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_mattr(docs: DataFrame, by: str, size: int, stride: int, text: str = "text", order: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(by, windows, mattr) over the full windows of each group's stream: micro-batch after micro-batch, by `order` within each.

    A batch numbers its tokens on from where the group's stream stood, takes the tokens of unfinished windows with it, counts the
    windows that are full now (many tasks a group), and writes sums, positions and those tokens (less than one window a group) under
    its epoch's number, so that an epoch that is done again replaces what it wrote."""
    spark = docs.sparkSession
    root = f"{folder or shared_folder(spark)}/mattr_{uuid.uuid4().hex}"
    held_schema = spark.createDataFrame([], f"{by} string, gpos long, token string").schema
    stood_schema = spark.createDataFrame([], f"{by} string, n long").schema

    def part(kind: str, epoch: int, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/{kind}/epoch={epoch}") if epoch >= 0 else spark.createDataFrame([], schema)

    def few(groups: DataFrame) -> DataFrame:
        """A row a group. Joined by a shuffle, a large group's tokens would all be one task's."""
        return F.broadcast(groups) if groups.limit(MANY + 1).count() <= MANY else groups

    def write(batch: DataFrame, epoch: int) -> None:
        stood = part("stood", epoch - 1, stood_schema)
        new = positions(batch.select(F.col(by).cast("string").alias(by), order, text), WS(F.col(text)), order, (by,))
        new = new.join(few(stood), by, "left").select(by, (F.col("gpos") + F.coalesce("n", F.lit(0))).alias("gpos"), "token")
        new = new.unionByName(part("held", epoch - 1, held_schema))
        new.write.mode("overwrite").parquet(f"{root}/tokens/epoch={epoch}")
        new = spark.read.schema(held_schema).parquet(f"{root}/tokens/epoch={epoch}")
        full = window_types(new, size, stride, (by,)).where(F.col("c") == size)
        full.groupBy(by).agg(F.count("*").alias("windows"), F.sum(F.col("types") / size).alias("total")).write.mode("overwrite").parquet(f"{root}/sums/epoch={epoch}")
        grown = new.groupBy(by).agg((F.max("gpos") + 1).alias("n"))
        stood.join(grown.withColumnRenamed("n", "m"), by, "full").select(by, F.coalesce("m", "n").alias("n")).write.mode("overwrite").parquet(f"{root}/stood/epoch={epoch}")
        grown = few(part("stood", epoch, stood_schema))
        # the first window that isn't full starts after the last full one
        start = F.when(F.col("n") >= size, (F.floor((F.col("n") - size) / stride) + 1) * stride).otherwise(F.lit(0))
        new.join(grown.select(by, start.alias("start")), by).where(F.col("gpos") >= F.col("start")).select(by, "gpos", "token").write.mode("overwrite").parquet(f"{root}/held/epoch={epoch}")

    docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    sums = spark.read.schema(f"{by} string, windows long, total double").parquet(f"{root}/sums")
    return sums.groupBy(by).agg(F.sum("windows").alias("windows"), (F.sum("total") / F.sum("windows")).alias("mattr"))


def run_once(stream: DataFrame, keys: str | list[str], mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, through the streaming engine. Every epoch is written to Parquet by the executors; the result
    holds what the last epoch wrote of each row (in complete mode, the last epoch)."""
    spark, keys = stream.sparkSession, [keys] if isinstance(keys, str) else keys
    folder = f"{checkpoint or shared_folder(spark)}/stream_{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # an epoch that is done again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema.add("epoch", "long")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    if mode == "append":
        return rows.drop("epoch")
    if mode == "complete":
        last = rows.agg(F.max("epoch")).first()[0]
        return rows.where(F.col("epoch") == F.lit(last)).drop("epoch")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "epoch").alias("__r"))
    return latest.select(*keys, "__r.*")


class EarlyExit(Exception):
    """A metric that has seen enough: it ends without a failure, the others go on."""


def run_all(batch: DataFrame, metrics: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[str, DataFrame], None]) -> dict[str, str | None]:
    """Every metric over one cached table, each by itself: name → None, 'early exit', or its error."""
    out: dict[str, str | None] = {}
    batch.persist()
    try:
        for name, metric in metrics.items():
            try:
                write(name, metric(batch))
                out[name] = None
            except EarlyExit:
                out[name] = "early exit"
            except Exception as e:  # noqa: BLE001 - one metric's failure must not stop the rest
                out[name] = type(e).__name__
    finally:
        batch.unpersist()
    return out


def fan_out(metrics: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[str, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch is cached once, every metric computed and written by itself; errors are reported at the end."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        failed = {}
        try:
            for name, metric in metrics.items():
                try:
                    write(name, metric(batch), epoch)
                except Exception as e:  # noqa: BLE001 - one metric's failure must not stop the rest
                    failed[name] = e
        finally:
            batch.unpersist()
        if len(failed) == len(metrics):
            raise RuntimeError(f"all metrics failed: {failed}")

    return run
