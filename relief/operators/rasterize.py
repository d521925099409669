"""Polygon -> cells (G6, G9) by scanline, entirely with DataFrame built-ins.

Rule: a cell belongs to a polygon when its **centre** is inside by the even-odd
rule; cells are half-open, so a centre on a left/bottom-facing edge is inside
and one on the opposite edge is outside.  Holes fall out of even-odd.

Plan (no theta join, no cross join):
  1. explode every edge into the cell rows whose centre line it crosses
     (``sequence`` over the edge's row span) -> one crossing per (edge, row);
  2. ``row_number``/``lead`` over (polygon, row) ordered by x pairs crossings
     1-2, 3-4, ... into spans;
  3. each span is cut at tile borders, ready for an equi-join with packed tiles on
     (col, row); only where cells are the result, it explodes into them.
Work is proportional to perimeter-rows + covered cells; a huge polygon spreads
over (id, gy) partitions, so one hot polygon does not land on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relief.schema import Grid, KeyBounds


def _edges(rings: Column) -> Column:
    """All directed edges of all rings; an unclosed ring gets its closing edge."""

    def ring_edges(r: Column) -> Column:
        n = F.size(r)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.get(r, i)["x"].alias("x1"),
                F.get(r, i)["y"].alias("y1"),
                F.get(r, (i + 1) % n)["x"].alias("x2"),
                F.get(r, (i + 1) % n)["y"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), ring_edges))


def polygon_spans(
    polygons: DataFrame, grid: Grid, id_col: str = "id", rings_col: str = "rings", carry: tuple[str, ...] = (), bounds: KeyBounds | None = None
) -> DataFrame:
    """Row spans ``(id, *carry, gy, gx_lo, gx_hi)`` (inclusive) of the cells inside each polygon.

    ``carry`` columns (per-polygon request parameters such as a flood level) ride
    along, so no join back to the request table is needed afterwards.  ``bounds``: a layer's key bounds; rows and cells
    outside them are cut off before anything is exploded, so a polygon larger than the layer costs no more than the layer."""
    carry = tuple(carry)
    e = polygons.select(F.col(id_col).alias("_pid"), *carry, F.explode(_edges(F.col(rings_col))).alias("e"))
    # grid units: u grows east, v grows south
    u1 = (F.col("e.x1") - F.lit(grid.xmin)) / F.lit(grid.cell_w)
    u2 = (F.col("e.x2") - F.lit(grid.xmin)) / F.lit(grid.cell_w)
    v1 = (F.lit(grid.ymax) - F.col("e.y1")) / F.lit(grid.cell_h)
    v2 = (F.lit(grid.ymax) - F.col("e.y2")) / F.lit(grid.cell_h)
    e = e.select("_pid", *carry, u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"))
    # rows whose centre line v = gy + 0.5 lies in [min(v1,v2), max(v1,v2)); horizontal edges give none
    lo = F.ceil(F.least("v1", "v2") - 0.5)
    hi = F.ceil(F.greatest("v1", "v2") - 0.5) - 1
    if bounds is not None:
        lo = F.greatest(lo, F.lit(bounds.row_min * grid.tile_rows))
        hi = F.least(hi, F.lit((bounds.row_max + 1) * grid.tile_rows - 1))
    e = e.where(F.col("v1") != F.col("v2")).select("*", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    x = e.select(
        "_pid", *carry, "u1", "v1", "u2", "v2", F.explode(F.sequence("lo", "hi")).alias("gy")
    ).select(
        "_pid",
        *carry,
        "gy",
        (F.col("u1") + ((F.col("gy") + 0.5) - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))).alias("u"),
    )
    w = Window.partitionBy("_pid", "gy").orderBy("u")
    spans = (
        x.select("_pid", *carry, "gy", "u", F.row_number().over(w).alias("rn"), F.lead("u").over(w).alias("u_end"))
        .where((F.col("rn") % 2 == 1) & F.col("u_end").isNotNull())
        .select(
            F.col("_pid").alias(id_col),
            *carry,
            F.col("gy").cast("bigint").alias("gy"),
            F.ceil(F.col("u") - 0.5).cast("bigint").alias("gx_lo"),
            (F.ceil(F.col("u_end") - 0.5) - 1).cast("bigint").alias("gx_hi"),
        )
    )
    if bounds is not None:
        spans = spans.withColumns({
            "gx_lo": F.greatest("gx_lo", F.lit(bounds.col_min * grid.tile_cols)), "gx_hi": F.least("gx_hi", F.lit((bounds.col_max + 1) * grid.tile_cols - 1))
        })
    return spans.where("gx_lo <= gx_hi")


def tile_spans(spans: DataFrame, grid: Grid, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Spans cut at tile borders: ``(*keys, col, row, at, cells)``, the place of the first cell in the tile's array and the
    number of cells."""
    tc, tr = grid.tile_cols, grid.tile_rows
    first, last = F.floor(F.col("gx_lo") / tc).cast("int"), F.floor(F.col("gx_hi") / tc).cast("int")
    s = spans.select(*keys, "gy", "gx_lo", "gx_hi", F.explode(F.sequence(first, last)).alias("col"), F.floor(F.col("gy") / tr).cast("int").alias("row"))
    lo = F.greatest(F.col("gx_lo"), F.col("col") * tc) - F.col("col") * tc
    hi = F.least(F.col("gx_hi"), (F.col("col") + 1) * tc - 1) - F.col("col") * tc
    at = (F.col("gy") - F.col("row") * tr) * tc + lo
    return s.select(*keys, "col", "row", at.cast("int").alias("at"), (hi - lo + 1).cast("int").alias("cells"))


def rasterize(
    polygons: DataFrame, grid: Grid, id_col: str = "id", rings_col: str = "rings", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *carry, gx, gy)`` for every cell centre inside each polygon (whole grid, unclipped)."""
    s = polygon_spans(polygons, grid, id_col, rings_col, carry)
    return s.select(id_col, *carry, F.explode(F.sequence("gx_lo", "gx_hi")).alias("gx"), "gy")


def polygon_tile_keys(polygons: DataFrame, grid: Grid, id_col: str = "id", rings_col: str = "rings", bounds: KeyBounds | None = None) -> DataFrame:
    """``(id, col, row)`` of the tiles that a polygon intersects (tiles half-open, holes left out).

    An edge walks through the tile rows that it passes, and in each through the columns between its ends there.  A tile that
    no edge enters lies inside or outside as a whole, as its centre does: a scanline over the grid of tiles."""
    tiles = Grid(grid.xmin, grid.ymax, grid.cell_w * grid.tile_cols, grid.cell_h * grid.tile_rows, 1, 1)
    e = polygons.select(F.col(id_col).alias("_pid"), F.explode(_edges(F.col(rings_col))).alias("e"))
    u, v = (lambda x: (x - F.lit(tiles.xmin)) / F.lit(tiles.cell_w)), (lambda y: (F.lit(tiles.ymax) - y) / F.lit(tiles.cell_h))
    e = e.select("_pid", u(F.col("e.x1")).alias("u1"), v(F.col("e.y1")).alias("v1"), u(F.col("e.x2")).alias("u2"), v(F.col("e.y2")).alias("v2"))
    r0, r1 = F.floor(F.least("v1", "v2")), F.floor(F.greatest("v1", "v2"))
    if bounds is not None:
        r0, r1 = F.greatest(r0, F.lit(bounds.row_min)), F.least(r1, F.lit(bounds.row_max))
    walk = e.withColumns({"_r0": r0, "_r1": r1}).where("_r0 <= _r1").select("*", F.explode(F.sequence("_r0", "_r1")).alias("row"))

    def u_at(line):
        """Where the edge is at a row line, no further than its own ends."""
        at = F.greatest(F.least("v1", "v2"), F.least(F.greatest("v1", "v2"), line))
        return F.when(F.col("v1") == F.col("v2"), F.col("u1")).otherwise(F.col("u1") + (at - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1")))

    a, b = u_at(F.col("row").cast("double")), F.when(F.col("v1") == F.col("v2"), F.col("u2")).otherwise(u_at((F.col("row") + 1).cast("double")))
    c0, c1 = F.floor(F.least(a, b)), F.floor(F.greatest(a, b))
    if bounds is not None:
        c0, c1 = F.greatest(c0, F.lit(bounds.col_min)), F.least(c1, F.lit(bounds.col_max))
    crossed = walk.withColumns({"_c0": c0, "_c1": c1}).where("_c0 <= _c1").select("_pid", F.explode(F.sequence("_c0", "_c1")).alias("col"), "row")
    inside = polygon_spans(polygons, tiles, id_col, rings_col, bounds=bounds)
    inside = inside.select(F.col(id_col).alias("_pid"), F.explode(F.sequence("gx_lo", "gx_hi")).alias("col"), F.col("gy").alias("row"))
    return crossed.unionByName(inside).distinct().select(F.col("_pid").alias(id_col), F.col("col").cast("int"), F.col("row").cast("int"))
