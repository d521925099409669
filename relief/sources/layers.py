"""Tile layer store on parquet (S1-S4) and result sinks.

A store is a folder with two tables:

* ``tiles``, partitioned by ``layer``, ``zoom``, ``version`` and ``block``.  A block is a square of
  ``BLOCK x BLOCK`` tile keys, numbered in Morton order, and its tiles lie in Morton order too: a
  pyramid level is a partition filter, and the lookup of a few keys opens the files of
  their blocks only.
* ``layers``, the catalogue: one row per layer and zoom with extent, layout, key bounds and counts,
  collected while the tiles were written and committed after them.  A reader follows
  the version that the catalogue names, so a write that fails leaves no trace in what is read,
  and neither bounds nor counts ever need a scan.

The catalogue's size is bounded by the number of layers, not by the data; it is the one side
broadcast without a runtime check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relief.functions.geo import morton
from relief.schema import LAYERS, TILES, Grid, KeyBounds

BLOCK = 32
#: ranges of blocks that a lookup's filter names, whatever the number of requests
RANGES = 64


def block_of(col: Column | str, row: Column | str) -> Column:
    """Number of the block that holds a tile key."""
    c, r = (F.floor((F.col(x) if isinstance(x, str) else x) / BLOCK) for x in (col, row))
    return morton(c, r)


def write_layer(tiles: DataFrame, path: str, layer: str, zoom: int, grid: Grid, cell_type: str = "float64", nodata: float | None = None) -> None:
    """Store packed tiles ``(col, row, data)`` as one pyramid level, in place of what the catalogue named before.

    The tiles are dealt into ranges of (block, Morton code); the catalogue's numbers are observed on the rows as they are
    written, each counted once whatever tasks are repeated."""
    spark = tiles.sparkSession
    version = uuid.uuid4().hex
    seen = Observation(f"layer-{version}")
    out = tiles.select(
        F.lit(layer).alias("layer"), F.lit(int(zoom)).alias("zoom"), F.lit(version).alias("version"), block_of("col", "row").alias("block"),
        F.col("col").cast("int"), F.col("row").cast("int"), F.col("data").cast("array<double>").alias("data"),
    ).withColumn("_code", morton("col", "row"))
    out = out.repartitionByRange("block", "_code").sortWithinPartitions("block", "_code").drop("_code")
    valid = F.array_compact("data")
    out = out.observe(
        seen,
        F.min("col").alias("col_min"), F.min("row").alias("row_min"), F.max("col").alias("col_max"), F.max("row").alias("row_max"),
        F.count(F.lit(1)).alias("tiles"), F.sum(F.size(valid)).alias("valid_cells"),
        F.min(F.array_min(valid)).alias("value_min"), F.max(F.array_max(valid)).alias("value_max"),
    )
    out.write.mode("append").partitionBy("layer", "zoom", "version", "block").parquet(f"{path}/tiles")
    row = _catalogue_row(seen.get, grid, layer, zoom, cell_type, nodata, version)
    entry = spark.createDataFrame([row], LAYERS).coalesce(1)
    entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "zoom").parquet(f"{path}/layers")


def _catalogue_row(m: dict, grid: Grid, layer: str, zoom: int, cell_type: str, nodata: float | None, version: str) -> tuple:
    w, h = grid.tile_cols * grid.cell_w, grid.tile_rows * grid.cell_h
    if not m["tiles"]:
        extent, bounds = None, None
    else:
        bounds = tuple(m[k] for k in ("col_min", "row_min", "col_max", "row_max"))
        extent = (grid.xmin + bounds[0] * w, grid.ymax - (bounds[3] + 1) * h, grid.xmin + (bounds[2] + 1) * w, grid.ymax - bounds[1] * h)
    return (
        layer, int(zoom), grid.crs, cell_type, nodata, extent, grid.tile_cols, grid.tile_rows, bounds,
        m["tiles"] or 0, m["valid_cells"] or 0, m["value_min"], m["value_max"], version,
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S3: the ``layers`` table, one row per layer and zoom."""
    names = [f.name for f in LAYERS.fields]
    return spark.read.schema(LAYERS).parquet(f"{path}/layers").select(*names)


def layer_entry(spark: SparkSession, path: str, layer: str, zoom: int) -> Row:
    """One row of the catalogue, on the driver."""
    found = read_catalogue(spark, path).where((F.col("layer") == layer) & (F.col("zoom") == int(zoom))).first()
    if found is None:
        raise ValueError(f"no layer {layer} at zoom {zoom} in {path}")
    return found


def entry_bounds(entry: Row) -> KeyBounds | None:
    """Key bounds of a catalogue row; None for a layer without tiles."""
    return None if entry.key_bounds is None else KeyBounds(**entry.key_bounds.asDict())


def entry_grid(entry: Row) -> Grid:
    """The layout of a layer with tiles, from its extent and key bounds."""
    e, b = entry.extent, entry.key_bounds
    w, h = (e.xmax - e.xmin) / (b.col_max - b.col_min + 1), (e.ymax - e.ymin) / (b.row_max - b.row_min + 1)
    return Grid(e.xmin - b.col_min * w, e.ymax + b.row_min * h, w / entry.tile_cols, h / entry.tile_rows, entry.tile_cols, entry.tile_rows, entry.crs)


def read_layer(spark: SparkSession, path: str, layer: str, zoom: int, blocks: list[tuple[int, int]] | None = None) -> DataFrame:
    """Tiles ``(layer, zoom, col, row, data)`` of one pyramid level; ``blocks``: only ranges of its blocks.  All conditions
    are on partition columns, so they choose files at planning time."""
    version = layer_entry(spark, path, layer, zoom).version
    stored = T.StructType([*TILES.fields, T.StructField("version", T.StringType()), T.StructField("block", T.LongType())])
    df = spark.read.schema(stored).parquet(f"{path}/tiles")
    df = df.where((F.col("layer") == layer) & (F.col("zoom") == int(zoom)) & (F.col("version") == version))
    if blocks is not None:
        inside = F.lit(False)
        for lo, hi in blocks:
            inside = inside | F.col("block").between(lo, hi)
        df = df.where(inside)
    return df.select("layer", "zoom", "col", "row", "data")


def touched_blocks(keys: DataFrame) -> list[tuple[int, int]]:
    """At most ``RANGES`` ranges of blocks that hold all of ``keys`` (col, row): equal parts of the span of their numbers, each
    shrunk to what is in it."""
    b = keys.where("col is not null and row is not null").select(block_of("col", "row").alias("block"))
    ends = b.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    if ends.lo is None:
        return []
    part = F.expr(f"(block - {ends.lo}) div {(ends.hi - ends.lo) // RANGES + 1}")
    return [(r.lo, r.hi) for r in b.groupBy(part.alias("part")).agg(F.min("block").alias("lo"), F.max("block").alias("hi")).collect()]


def lookup_tiles(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every request ``(…, layer, zoom, col, row)`` keeps its row; ``data`` is NULL
    when the key is absent (the reference's "value not found" -> None)."""
    t = tiles.select("layer", "zoom", "col", "row", "data")
    return requests.join(t, ["layer", "zoom", "col", "row"], "left")


def lookup_stored(requests: DataFrame, path: str, layer: str, zoom: int) -> DataFrame:
    """S2 on a store, for requests of one pyramid level: only the files of the blocks they touch are read."""
    held = read_layer(requests.sparkSession, path, layer, zoom, touched_blocks(requests))
    return lookup_tiles(requests, held)


def layer_metadata(tiles: DataFrame, grid: Grid, layer: str, zoom: int, cell_type: str = "float64", nodata: float | None = None) -> DataFrame:
    """S3 of tiles that are in no store: their ``layers`` row by one aggregate."""
    valid = F.array_compact("data")
    m = tiles.agg(
        F.min("col").alias("col_min"), F.min("row").alias("row_min"), F.max("col").alias("col_max"), F.max("row").alias("row_max"),
        F.count(F.lit(1)).alias("tiles"), F.sum(F.size(valid)).alias("valid_cells"),
        F.min(F.array_min(valid)).alias("value_min"), F.max(F.array_max(valid)).alias("value_max"),
    ).first()
    return tiles.sparkSession.createDataFrame([_catalogue_row(m.asDict(), grid, layer, zoom, cell_type, nodata, "")], LAYERS)


def within_key_bounds(requests: DataFrame, layers: DataFrame) -> DataFrame:
    """Keep requests whose key lies inside the layer's key bounds (others get no
    result even if neighbouring tiles exist).  ``layers`` has one row per layer
    and zoom, a bounded catalogue, so it is broadcast."""
    m = F.broadcast(layers.select("layer", "zoom", "key_bounds"))
    kb = F.col("key_bounds")
    return (
        requests.join(m, ["layer", "zoom"])
        .where(F.col("col").between(kb["col_min"], kb["col_max"]) & F.col("row").between(kb["row_min"], kb["row_max"]))
        .drop("key_bounds")
    )


# --- S11 sinks -------------------------------------------------------------------

def write_tiles(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("layer", "zoom"), mode: str = "overwrite") -> None:
    """Tile products as parquet, partitioned like the source pyramid."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Statistics and GeoJSON features as JSON lines (one object per row)."""
    df.write.mode(mode).json(path)
