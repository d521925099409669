"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from relief.session import ensure_checkpoint_dir


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back.

    Cuts the lineage: later jobs read the files, so a lost executor costs no recomputation of what came before.
    The folder is the one the session names in ``spark.checkpoint.dir``.  The table goes when the session's process ends, or
    before by ``drop_table``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _folder(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_table(*tables: DataFrame | None) -> None:
    """Delete the files of shared tables that nothing will read any more."""
    for table in tables:
        if table is not None:
            where, files = _folder(table.sparkSession, table.shared_path)
            files.delete(where, True)


def bounded_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Yield consecutive slices of ``batch`` whose ``column`` holds at most ``max_bytes`` plus one row's bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
        yield batch.slice(int(lo), int(hi - lo))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column back to back, and the offsets of its rows; a null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public MurmurHash3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
