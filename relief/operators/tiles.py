"""Tile <-> cell forms and neighbourhood assembly.

Packed tiles are the stored form: one row per (col, row) key holding a dense
row-major ``ARRAY<DOUBLE>`` of ``tile_cols * tile_rows`` cells, NULL = NODATA.
Cells ``(gx, gy, value)`` are the exploded form; their global index is the
mosaic, so a "stitch" never materialises one big array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relief.functions.geo import tile_key
from relief.schema import Grid, KeyBounds


def dense(arr: pa.Array, length: int) -> np.ndarray:
    """A list column of fixed-length lists (NULL list or NULL item -> NaN) as (rows, length)."""
    out = np.full((len(arr), length), np.nan)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    if valid.any():
        vals = arr.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False)
        out[valid] = np.asarray(vals, dtype=float).reshape(-1, length)
    return out


def raster_from_array(df: DataFrame, array_col: str, cols: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row-major array column of width ``cols`` -> cells ``(gx, gy, value)``."""
    e = df.select(*keep, F.posexplode(F.col(array_col)).alias("pos", "v"))
    return e.select(
        *keep,
        (F.col("pos") % cols).cast("bigint").alias("gx"),
        F.expr(f"pos div {int(cols)}").cast("bigint").alias("gy"),
        F.col("v").cast("double").alias("value"),
    )


def pack(cells: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells -> tiles ``(*keys, col, row, data)``; cells absent from the input are NULL.

    The group is one tile, so its size is bounded by the layout, never by the data.
    A full tile (the common case) is its index-sorted value list; a partial tile
    gets its missing indices from a hash-based ``array_except`` as NULL entries
    and is sorted once -- O(n log n) per tile, no per-cell lookup."""
    col, row = tile_key(grid, "gx", "gy")
    idx = (F.col("gy") - row * grid.tile_rows) * grid.tile_cols + (F.col("gx") - col * grid.tile_cols)
    c = cells.select(*keys, col.alias("col"), row.alias("row"), idx.cast("int").alias("i"), "value")
    g = c.groupBy(*keys, "col", "row").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"))
    full = F.transform("s", lambda e: e["value"])
    missing = F.array_except(F.sequence(F.lit(0), F.lit(grid.tile_size - 1)), F.transform("s", lambda e: e["i"]))
    filler = F.transform(missing, lambda j: F.struct(j.alias("i"), F.lit(None).cast("double").alias("value")))
    gaps = F.transform(F.array_sort(F.concat("s", filler)), lambda e: e["value"])
    data = F.when(F.size("s") == grid.tile_size, full).otherwise(gaps)
    return g.select(*keys, "col", "row", data.alias("data"))


def unpack(tiles: DataFrame, grid: Grid, keys: tuple[str, ...] = (), keep_nodata: bool = True) -> DataFrame:
    """S9 back: the cells of the tiles that there are.  ``keep_nodata`` keeps NODATA cells as NULL rows."""
    e = tiles.select(*keys, "col", "row", F.posexplode("data").alias("pos", "value"))
    out = e.select(
        *keys,
        (F.col("col") * grid.tile_cols + F.col("pos") % grid.tile_cols).cast("bigint").alias("gx"),
        (F.col("row") * grid.tile_rows + F.expr(f"pos div {grid.tile_cols}")).cast("bigint").alias("gy"),
        "value",
    )
    return out if keep_nodata else out.where(F.col("value").isNotNull())


def stitch(tiles: DataFrame, grid: Grid, bounds: KeyBounds) -> DataFrame:
    """M1: the layer as one raster: a cell ``(gx, gy, value)`` for every key inside ``bounds``, NODATA where a tile is missing.

    The key grid is generated in parallel and joined to the tiles that there are."""
    cols = bounds.col_max - bounds.col_min + 1
    n = cols * (bounds.row_max - bounds.row_min + 1)
    keys = tiles.sparkSession.range(n).select(
        (F.col("id") % cols + bounds.col_min).cast("int").alias("col"), (F.expr(f"id div {cols}") + bounds.row_min).cast("int").alias("row")
    )
    held = keys.join(tiles.select("col", "row", "data"), ["col", "row"], "left")
    gap = F.array_repeat(F.lit(None).cast("double"), F.lit(grid.tile_size))
    return unpack(held.withColumn("data", F.coalesce("data", gap)), grid)


def crop(cells: DataFrame, gx0: int, gy0: int, gx1: int, gy1: int) -> DataFrame:
    """M3: inclusive bounds, pushed down as a plain range filter."""
    return cells.where(F.col("gx").between(gx0, gx1) & F.col("gy").between(gy0, gy1))


def crop_tiles(tiles: DataFrame, grid: Grid, gx0: int, gy0: int, gx1: int, gy1: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """M3 on packed tiles: only the tiles of the window are unpacked (a predicate on the key, which reaches a stored layer's
    scan), then :func:`crop`."""
    col, row = F.col("col"), F.col("row")
    held = tiles.where(col.between(gx0 // grid.tile_cols, gx1 // grid.tile_cols) & row.between(gy0 // grid.tile_rows, gy1 // grid.tile_rows))
    return crop(unpack(held, grid, keys), gx0, gy0, gx1, gy1)


# --- M2: halo exchange -------------------------------------------------------

ROLES = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def _strips(grid: Grid, width: int) -> list[tuple[int, int, str, Column]]:
    """What a tile sends to each neighbour: (dcol, drow, role at the receiver, strip of ``width`` cells, row-major)."""
    tc, tr = grid.tile_cols, grid.tile_rows
    d = F.col("data")

    def block(x: int, y: int, w: int, h: int) -> Column:
        if w == tc:
            return F.slice(d, y * tc + 1, w * h)
        place = lambda i: F.get(d, (F.lit(y) + F.floor(i / w)) * tc + x + i % w)
        return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), place)

    n, w, e = width, 0, tc - width
    return [
        (0, 1, "n", block(0, tr - n, tc, n)),  # I am the north neighbour of the tile below me
        (0, -1, "s", block(0, 0, tc, n)),
        (1, 0, "w", block(e, 0, n, tr)),
        (-1, 0, "e", block(w, 0, n, tr)),
        (1, 1, "nw", block(e, tr - n, n, n)),
        (-1, 1, "ne", block(w, tr - n, n, n)),
        (1, -1, "sw", block(e, 0, n, n)),
        (-1, -1, "se", block(w, 0, n, n)),
    ]


def halo(tiles: DataFrame, grid: Grid, keys: tuple[str, ...] = (), diagonals: bool = True, width: int = 1) -> DataFrame:
    """M2: every tile with its neighbours' edge strips ``(*keys, col, row, data, n, s, w, e, nw, ne, sw, se)``.

    Each tile emits itself plus strips of ``width`` cells to its 8 neighbours; one shuffle on
    the tile key gathers them (about (1 + 4 width/tile_cols) x the layer).  An absent
    neighbour leaves its strip NULL (NODATA).  ``diagonals=False`` reproduces the
    reference's plus-shaped mosaic (corners NODATA)."""
    if width > min(grid.tile_cols, grid.tile_rows):
        raise ValueError(f"a halo of {width} cells is wider than a tile")
    strips = [s for s in _strips(grid, width) if diagonals or len(s[2]) == 1]
    msgs = F.array(
        F.struct(F.lit(0).alias("dc"), F.lit(0).alias("dr"), F.lit("c").alias("role"), F.col("data").alias("strip")),
        *[F.struct(F.lit(dc).alias("dc"), F.lit(dr).alias("dr"), F.lit(role).alias("role"), s.alias("strip")) for dc, dr, role, s in strips],
    )
    m = tiles.select(*keys, "col", "row", F.explode(msgs).alias("m")).select(
        *keys,
        (F.col("col") + F.col("m.dc")).alias("col"),
        (F.col("row") + F.col("m.dr")).alias("row"),
        F.col("m.role").alias("role"),
        F.col("m.strip").alias("strip"),
    )
    # one message per (tile, role): a hash aggregate of the 9 messages, no sort
    g = m.groupBy(*keys, "col", "row").agg(F.map_from_entries(F.collect_list(F.struct("role", "strip"))).alias("_m"))
    g = g.select(*keys, "col", "row", *[F.try_element_at("_m", F.lit(r)).alias(r) for r in ("c",) + ROLES])
    return g.where(F.col("c").isNotNull()).withColumnRenamed("c", "data")


def few_tiles(batches: Iterator[pa.RecordBatch], grid: Grid, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``cells`` cells, one tile at least: a kernel's arrays over a slice stay small whatever
    Arrow's batch size."""
    step = max(1, cells // grid.tile_size)
    for rb in batches:
        for lo in range(0, rb.num_rows, step):
            yield rb.slice(lo, step)


def padded(rb: pa.RecordBatch, grid: Grid, width: int = 1) -> np.ndarray:
    """The tiles of a batch of :func:`halo` with their strips around them: ``k x (rows + 2 width) x (cols + 2 width)``, NaN = NODATA."""
    tc, tr, n, k = grid.tile_cols, grid.tile_rows, width, rb.num_rows
    out = np.full((k, tr + 2 * n, tc + 2 * n), np.nan)
    out[:, n : n + tr, n : n + tc] = dense(rb.column("data"), tc * tr).reshape(k, tr, tc)
    if n:
        top, bottom, left, right, row, col = slice(0, n), slice(n + tr, None), slice(0, n), slice(n + tc, None), slice(n, n + tr), slice(n, n + tc)
        for role, ys, xs, h, w in (
            ("n", top, col, n, tc), ("s", bottom, col, n, tc), ("w", row, left, tr, n), ("e", row, right, tr, n),
            ("nw", top, left, n, n), ("ne", top, right, n, n), ("sw", bottom, left, n, n), ("se", bottom, right, n, n),
        ):
            out[:, ys, xs] = dense(rb.column(role), h * w).reshape(k, h, w)
    return out


def list_column(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """``k x cells`` (NaN = NULL) as a list column."""
    flat = np.ascontiguousarray(values).reshape(-1)
    gone = np.isnan(flat)
    items = pa.array(flat, mask=gone) if kind is None else pa.array(np.where(gone, 0, flat).astype(kind.to_pandas_dtype()), mask=gone)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, values.shape[1], dtype=np.int32)), items)
