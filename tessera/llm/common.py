"""What the operators of this subpackage share: session set-up, checkpoints, hashing, connected components."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import set_checkpoints, shared_folder, spread

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes as well as rows, and let Python workers find this package.

    A batch of very long texts must fit beside the executor's heap, whatever the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    # workers are kept between tasks: what they free goes back to the system, not to their own pools
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(8 << 20))
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. A small one with texts, of fewer splits than there are cores, is spread over them."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if {"text", "html"} & set(df.columns) else df


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the unit that every exchange here is sized by."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through files that all executors share (the session's spark.checkpoint.dir)."""
    set_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished work go once the driver has collected what referred to them; ask it to, between stages, so that a
    stage's files aren't held on disk beside the next one's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_bytes(parts: list[bytes], seed: int = 0) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (vectorised, wraps on overflow)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (smallest member's index) of n nodes linked by the pairs (a, b), by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links that one task holds by a star per component; bounded by its own links."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = min_labels(len(nodes), at[: len(a)], at[len(a) :])
        keep = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["v", "m"])


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(v, m): every node of the links (a, b), with the smallest node that it reaches.

    Alternating large-star and small-star rounds on (v, m) rows until nothing changes. Each round takes
    grouped minima, which combine before the shuffle, and joins them back, so that a node with very many
    neighbours is no single task's group (the join splits under AQE). Every round ends in a checkpoint.
    Nodes without a link to another node aren't returned. Null ends are ignored; self-links and repeated
    links change nothing. Rounds grow with the logarithm of a component's size; should `rounds` of them not be
    enough, that is an error, never an unfinished result."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("m")).where("v is not null and m is not null and v <> m")
    e = checkpoint(e.mapInArrow(_contract, "v long, m long").distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("n")).select("v", F.least("v", "n").alias("n"))
        # large star: neighbours above v go to v's least neighbour
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("n").alias("m")).where("v <> m").distinct()
        # small star: neighbours below v, and v itself, go to the least
        low = large.groupBy("v").agg(F.min("m").alias("n"))
        small = large.join(low, "v").select(F.col("m").alias("v"), F.col("n").alias("m")).union(low.select("v", F.col("n").alias("m")))
        e = checkpoint(small.where("v <> m").distinct())
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, m))"), F.countDistinct("v")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return e.unionByName(e.select(F.col("m").alias("v"), "m").distinct())


def materialize(df: DataFrame) -> DataFrame:
    """As checkpoint, for wide rows: a compressed Parquet table in the shared folder, read back."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df whose columns of these names (in any case) are called name_0, or the first such name that is free: an operator adds columns
    by these names, and nothing of the table is lost or ambiguous."""
    taken, wanted = {c.lower() for c in df.columns} | {n.lower() for n in names}, {n.lower() for n in names}
    new = []
    for c in df.columns:
        if c.lower() in wanted:
            k = next(k for k in range(len(taken) + 1) if f"{c.lower()}_{k}" not in taken)
            taken.add(f"{c.lower()}_{k}")
            c = f"{c}_{k}"
        new.append(c)
    return df.toDF(*new) if new != df.columns else df


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... start + length - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
