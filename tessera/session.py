"""Session builder with the settings that the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE (with skew joins and coalescing) and Arrow on, UTC; everything else is the cluster's to say."""
    b = SparkSession.builder.appName("tessera")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where lineage is cut: the cluster's spark.checkpoint.dir. Only a session in local mode that names none gets a temporary
    folder, which goes at its end; elsewhere a machine's own folder would be no use to the others, so that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir("file://" + folder)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def set_checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = shared_folder(spark)
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)


def spread(df: DataFrame) -> DataFrame:
    """A small table that its files would give to fewer tasks than there are cores goes to all of them; any other stays as it is.

    Texts cost much more to work on than to move; files that give every core a task aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
