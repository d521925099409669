"""Focal 3x3 operators (F0-F5) in two physical forms with one meaning.

* :func:`focal_tiles` -- production path.  Halo exchange (M2) gathers each tile
  with its neighbours' 1-cell edge strips in **one** shuffle of about
  ``(1 + 4/tile_cols)`` x the layer, then a NumPy kernel runs per tile inside
  ``mapInArrow`` (Arrow batches, no per-cell Python).  The unit of work is one
  tile, so memory per task is bounded by the layout, not the data.
* :func:`focal_cells` -- pure built-in path.  Each cell is scattered to its 9
  window positions and pivoted back with ``groupBy``; 9x the shuffle volume,
  used as the SQL-readable twin in tests.
"""

from __future__ import annotations

import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relief.functions.kernels import NAMES, OFFSETS, kernel_col, kernel_np
from relief.operators.tiles import ROLES, few_tiles, halo, list_column, padded
from relief.schema import Grid


def neighbourhood_cells(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """F0 on cells: ``(*keys, gx, gy, a..i)``; a missing neighbour is NULL.

    Only cells present in the input get a row.  Partial aggregation merges the
    scattered copies map-side before the shuffle."""
    msgs = F.array(
        *[F.struct(F.lit(-dx).alias("ox"), F.lit(-dy).alias("oy"), F.lit(n).alias("slot")) for n, (dx, dy) in OFFSETS.items()]
    )
    s = cells.select(*keys, "gx", "gy", "value", F.explode(msgs).alias("m")).select(
        *keys,
        (F.col("gx") + F.col("m.ox")).alias("gx"),
        (F.col("gy") + F.col("m.oy")).alias("gy"),
        F.col("m.slot").alias("slot"),
        "value",
    )
    aggs = [F.max(F.when(F.col("slot") == n, F.col("value"))).alias(n) for n in NAMES]
    aggs.append(F.max((F.col("slot") == "e").cast("int")).alias("_here"))
    return s.groupBy(*keys, "gx", "gy").agg(*aggs).where("_here = 1").drop("_here")


def focal_cells(cells: DataFrame, op: str, keys: tuple[str, ...] = (), **kw) -> DataFrame:
    """F1-F5 on cells: ``(*keys, gx, gy, value)``.  ``zfactor`` scales values first (L3)."""
    if kw.get("zfactor") is not None:
        cells = cells.withColumn("value", F.col("value") * F.lit(kw["zfactor"]))
    return neighbourhood_cells(cells, keys).select(*keys, "gx", "gy", kernel_col(op, **kw).alias("value"))


# --- tile path -------------------------------------------------------------------

def _tile_kernel(op: str, grid: Grid, keys: tuple[str, ...], kw: dict):
    """Arrow batch -> batch: every tile of the batch is padded and processed at once."""

    def run(batches):
        warnings.simplefilter("ignore", RuntimeWarning)
        for rb in few_tiles(batches, grid):
            values = kernel_np(op, padded(rb, grid), **kw)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in (*keys, "col", "row")), list_column(values.reshape(len(values), -1))], [*keys, "col", "row", "data"])

    return run


def focal_tiles(tiles: DataFrame, grid: Grid, op: str, keys: tuple[str, ...] = (), diagonals: bool = True, **kw) -> DataFrame:
    """F1-F5 on packed tiles: ``(*keys, col, row, data)`` of the same layout.  Several steps in one pass: ``plans.compose``."""
    h = halo(tiles, grid, keys, diagonals).select(*keys, "col", "row", "data", *ROLES)
    schema = T.StructType(
        [h.schema[k] for k in keys]
        + [T.StructField("col", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("data", T.ArrayType(T.DoubleType()))]
    )
    return h.mapInArrow(_tile_kernel(op, grid, tuple(keys), dict(kw)), schema)
