"""Session helpers: sane defaults for local runs, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "relief") -> SparkSession:
    """Session for tests and the bench.  On a cluster use the cluster's own builder."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session names none (local tests) a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="relief-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the session's process ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df):
    """``df`` written as a table to the shared checkpoint folder, and read back.

    Unlike a checkpoint, the table tells Catalyst its size: joins with it are broadcast or shuffled by what it really holds,
    not by an estimate that knows nothing of an ``explode``.  The files go when the session's process ends."""
    path = scratch_path(df.sparkSession, "table") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, rows_per_partition: int = 1_000_000):
    """Reliable checkpoint into the shared checkpoint folder, computed once.

    ``Dataset.checkpoint`` runs its plan for the eager job and again to write the
    files; persisting first lets the write read the blocks of the first run.  The
    row count of the persisted blocks sizes the checkpoint (about
    ``rows_per_partition`` rows per file, never more partitions than it had, a
    narrow coalesce without shuffle): later stages read a checkpoint as-is, so
    hundreds of near-empty partitions would otherwise follow every round.  The
    blocks are released as soon as the checkpoint exists, so a lost executor is
    recovered from the checkpoint files, never from machine-local state."""
    import math

    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = p.count()
    parts = p.rdd.getNumPartitions()
    target = max(1, min(parts, math.ceil(n / rows_per_partition)))
    out = (p.coalesce(target) if target < parts else p).checkpoint(eager=True)
    p.unpersist()
    return out
