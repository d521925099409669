"""Viewsheds for whole observer tables (V1-V5).

Cells are ``(gx, gy, value)``, tiles ``(col, row, data)``; an observer is ``(id, ox, oy, oz, radius)`` in grid
units (``observer_cells`` derives it from map coordinates and the DEM).  Slopes
are ``(z - oz) / d`` with ``d`` in cells -- the cell size scales every slope of a
ray alike, so it does not change any comparison.  NODATA and off-raster cells
neither block a ray nor get a result.  The observer's own cell is visible.

Physical plan of the perimeter-ray viewshed (V2), per observer of radius R:
  rays   8R perimeter targets (``explode(sequence)``), dealt out over all tasks,
  steps  R samples per ray, the nearest cell at each major-axis step,
  join   a few samples: broadcast to the raster's cells (equi-join on the cell
         index, no theta join); more: the runs of a ray's samples that lie in one
         tile = the packed tile, from which they take the values of all their
         steps, so no sample is shuffled by itself,
  window running max of the slope over (observer, ray) ordered by step --
         a window partition is one ray (R rows); neighbouring rays of at most
         SECTOR_SAMPLES samples (or one ray) are dealt out together, so no
         partition grows with the data or with a hot observer,
  group  max(visible) per (observer, cell), first within such a sector.
About 8R^2 samples per observer.

The approximate viewshed (V4) goes ring by ring: the horizon of a cell is
interpolated between the two cells of the ring inside it that its line of sight
passes, so every valid cell has an answer, at the cost of one look per cell.
Observers of one tile share their window of packed tiles; a task holds one window,
whose size the request's radius or buffer sets, not the layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relief.functions.geo import map_to_grid_x, map_to_grid_y, point_rect_dist2, tile_extent
from relief.operators.joins import join_bounded, max_broadcast_bytes, prune_to_tiles, row_bound
from relief.operators.stream import grouped, whole_groups
from relief.operators.tiles import dense, pack
from relief.schema import Grid
from relief.session import cut_lineage


def samples_bound(obs: DataFrame, ray_step: int = 1) -> int:
    """Proven upper bound of the ray samples of an observer table."""
    r = F.col("radius")
    return row_bound(obs, (F.floor((8 * r - 1) / ray_step) + 1) * r)


def observer_cells(observers: DataFrame, dem: DataFrame, grid: Grid, carry: tuple[str, ...] = ()) -> DataFrame:
    """V1: ``(id, ox, oy, oz, radius, *carry)``; oz = DEM value under the observer + height.

    An observer off the DEM or on NODATA has no elevation and gets no viewshed."""
    o = observers.select(
        "id",
        *carry,
        map_to_grid_x(grid, "x").alias("ox"),
        map_to_grid_y(grid, "y").alias("oy"),
        F.coalesce(F.col("height"), F.lit(0.0)).alias("height"),
        F.col("radius").cast("int").alias("radius"),
    )
    d = dem.select(F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("value").alias("ground"))
    return (
        o.join(d, ["ox", "oy"])
        .where(F.col("ground").isNotNull())
        .select("id", "ox", "oy", (F.col("ground") + F.col("height")).alias("oz"), "radius", *carry)
    )


def _perimeter(t: Column, r: Column) -> tuple[Column, Column]:
    """(dx, dy) of perimeter position t in [0, 8r) of the square ring of radius r."""
    side = F.floor(t / (2 * r))
    k = t - side * 2 * r
    dx = F.when(side == 0, -r + k).when(side == 1, r).when(side == 2, r - k).otherwise(-r)
    dy = F.when(side == 0, -r).when(side == 1, -r + k).when(side == 2, r).otherwise(r - k)
    return dx.cast("int"), dy.cast("int")


def _nearest(k: Column, d: Column, r: Column) -> Column:
    """round(k * d / r) half up, exact for integer inputs."""
    k, d, r = (c.cast("bigint") for c in (k, d, r))  # 2 * k * d leaves INT from R = 32,768 on
    return F.floor((2 * k * d + r).cast("double") / (2 * r).cast("double")).cast("bigint")


EXTENT_COLS = ("bx0", "by0", "bx1", "by1")


def _last_step(clip: bool) -> Column:
    """Last step of a ray.  With the raster's cell extent on the observer row
    (``bx0, by0, bx1, by1``) a ray stops once it has left the extent: its offset
    ``round(k*d/R)`` grows monotonically, so no later sample can hit a cell.
    The bound is conservative (``ceil``); the join drops the rest."""
    r = F.col("radius").cast("bigint")
    if not clip:
        return r

    def axis(d: str, o: str, lo: str, hi: str) -> Column:
        dd = F.col(d)
        pos = F.ceil(r * (2 * (F.col(hi) - F.col(o)) + 1) / (2 * dd))
        neg = F.ceil(r * (2 * (F.col(o) - F.col(lo)) + 1) / (-2 * dd))
        return F.when(dd > 0, pos).when(dd < 0, neg).otherwise(r)

    return F.least(r, axis("dx", "ox", "bx0", "bx1"), axis("dy", "oy", "by0", "by1")).cast("int")


def _rays(obs: DataFrame, ray_step: int) -> DataFrame:
    """``(id, ox, oy, oz, radius, ray, dx, dy)`` and the raster's extent if the observers have it."""
    ext = [c for c in EXTENT_COLS if c in obs.columns]
    rays = obs.select(
        "id", "ox", "oy", "oz", "radius", *ext,
        F.explode(F.sequence(F.lit(0), 8 * F.col("radius") - 1, F.lit(int(ray_step)))).alias("ray"),
    ).where(F.col("radius") > 0)
    # one observer's rays are many tasks' work; a fixed number, as their few bytes would be coalesced into one task
    rays = rays.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "ray")
    dx, dy = _perimeter(F.col("ray"), F.col("radius"))
    return rays.select("id", "ox", "oy", "oz", "radius", *ext, "ray", dx.alias("dx"), dy.alias("dy"))


def _sample(k: Column) -> tuple[Column, Column]:
    """Offsets from the observer of step k of a ray."""
    return _nearest(k, F.col("dx"), F.col("radius")), _nearest(k, F.col("dy"), F.col("radius"))


def _at_steps(steps: DataFrame, *more: str) -> DataFrame:
    """``(id, ray, k, gx, gy, dist, oz, *more)`` of rays with their steps k."""
    sx, sy = _sample(F.col("k"))
    return steps.select(
        "id", "ray", "k", "oz", *more,
        (F.col("ox") + sx).cast("bigint").alias("gx"),
        (F.col("oy") + sy).cast("bigint").alias("gy"),
        F.sqrt((sx * sx + sy * sy).cast("double")).alias("dist"),
    )


def ray_samples(obs: DataFrame, ray_step: int = 1) -> DataFrame:
    """``(id, ray, k, gx, gy, dist, oz, sector)`` samples of the perimeter rays of each observer."""
    rays = _rays(obs, ray_step).withColumn("sector", _sector())
    return _at_steps(rays.select("*", F.explode(F.sequence(F.lit(1), _last_step("bx0" in rays.columns))).alias("k")), "sector")


#: steps of a ray that are looked up together, and samples of the neighbouring rays of an observer that are dealt out together
PIECE_STEPS = 32
SECTOR_SAMPLES = 1 << 16
#: of a sample that is broadcast
SAMPLE_BYTES = 56


def _sector() -> Column:
    """Number of a ray's group of neighbouring rays, of at most SECTOR_SAMPLES samples or one ray."""
    return F.floor(F.col("ray") / F.greatest(F.lit(1), F.floor(F.lit(SECTOR_SAMPLES) / F.col("radius"))))


def _looked_up(obs: DataFrame, tiles: DataFrame, grid: Grid, ray_step: int, keyed: bool) -> DataFrame:
    """``(id, sector, ray, k, gx, gy, dist, oz, value)`` of the samples with a value.

    Offsets grow monotonically along a ray, so the steps of a piece that lie in one tile follow each other: such a run is
    joined with its tile as one row, and carries its values as a list until its sector is together."""
    rays = _rays(obs, ray_step)
    last = _last_step("bx0" in rays.columns).cast("bigint")
    rays = rays.withColumn("last", last).where("last >= 1").drop(*EXTENT_COLS)
    pieces = rays.withColumn("from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last"), F.lit(PIECE_STEPS).cast("bigint"))))
    steps = F.sequence("from", F.least(F.col("from") + (PIECE_STEPS - 1), "last"))

    def tile(k: Column) -> Column:
        sx, sy = _sample(k)
        return F.struct(F.floor((F.col("ox") + sx) / grid.tile_cols).cast("int").alias("col"), F.floor((F.col("oy") + sy) / grid.tile_rows).cast("int").alias("row"))

    runs = pieces.withColumn("tiles", F.transform(steps, tile)).withColumn("tile", F.explode(F.array_distinct("tiles")))
    first = F.col("from") + F.array_position("tiles", F.col("tile")) - 1
    n = F.size(F.filter("tiles", lambda t: t == F.col("tile")))
    own = ["id", "ray", "ox", "oy", "oz", "radius", "dx", "dy"]
    runs = runs.select(*own, first.alias("from"), (first + n - 1).alias("to"), "tile.col", "tile.row")

    def value(k: Column) -> Column:
        sx, sy = _sample(k)
        x, y = F.col("ox") + sx - F.col("col") * grid.tile_cols, F.col("oy") + sy - F.col("row") * grid.tile_rows
        return F.get(F.col("data"), (y * grid.tile_cols + x).cast("int"))

    held = tiles.join(runs.hint("merge"), [*(["id"] if keyed else []), "col", "row"])
    held = held.select(*own, "from", F.transform(F.sequence("from", "to"), value).alias("values"), _sector().alias("sector"))
    # a fixed number, as partitions coalesced by their lists' bytes would sort many more samples
    held = held.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "sector")
    dealt = held.select(*own, "sector", "from", F.posexplode("values").alias("at", "value")).where("value is not null")
    return _at_steps(dealt.withColumn("k", F.col("from") + F.col("at")), "sector", "value")


def _valid(cells: DataFrame, keyed: bool) -> DataFrame:
    keys = ["id"] if keyed else []
    return cells.where(F.col("value").isNotNull()).select(*keys, "gx", "gy", "value")


def observer_tile_keys(obs: DataFrame, grid: Grid, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *carry, col, row)``: tiles of each observer's square of radius R, inside the extent on its row if it has one."""
    lo, hi = {"x": F.col("ox") - F.col("radius"), "y": F.col("oy") - F.col("radius")}, {"x": F.col("ox") + F.col("radius"), "y": F.col("oy") + F.col("radius")}
    if all(c in obs.columns for c in EXTENT_COLS):
        lo = {d: F.greatest(v, F.col(f"b{d}0")) for d, v in lo.items()}
        hi = {d: F.least(v, F.col(f"b{d}1")) for d, v in hi.items()}
    c0, c1 = (F.floor(side["x"] / grid.tile_cols).cast("int") for side in (lo, hi))
    r0, r1 = (F.floor(side["y"] / grid.tile_rows).cast("int") for side in (lo, hi))
    k = obs.where((c0 <= c1) & (r0 <= r1)).select("id", *carry, F.explode(F.sequence(c0, c1)).alias("col"), r0.alias("r0"), r1.alias("r1"))
    return k.select("id", *carry, "col", F.explode(F.sequence("r0", "r1")).alias("row"))


def viewshed_r2(obs: DataFrame, cells: DataFrame, ray_step: int = 1, keyed: bool = False, prune_grid: Grid | None = None) -> DataFrame:
    """V2: ``(id, gx, gy, vis)`` for every valid cell reached by a perimeter ray.

    ``keyed``: ``cells`` carry an observer ``id`` (each observer sees its own surface)."""
    on = ["id", "gx", "gy"] if keyed else ["gx", "gy"]
    bound = samples_bound(obs, ray_step)
    if bound * SAMPLE_BYTES <= max_broadcast_bytes(obs):
        s = join_bounded(_valid(cells, keyed), ray_samples(obs, ray_step), on, bound, row_bytes=SAMPLE_BYTES).repartition("id", "sector")
    else:
        grid = prune_grid or Grid(xmin=0.0, ymax=0.0, cell_w=1.0, cell_h=1.0, tile_cols=32, tile_rows=32)
        if prune_grid is not None and not keyed:
            side = F.floor(2 * F.col("radius") / min(grid.tile_cols, grid.tile_rows)) + 2
            cells = prune_to_tiles(cells, observer_tile_keys(obs, grid), grid, min(bound, row_bound(obs, side * side)))
        s = _looked_up(obs, pack(cells, grid, ("id",) if keyed else ()), grid, ray_step, keyed)
    s = s.select("id", "sector", "ray", "k", "gx", "gy", ((F.col("value") - F.col("oz")) / F.col("dist")).alias("slope"))
    w = Window.partitionBy("id", "sector", "ray").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    seen = s.select("id", "sector", "gx", "gy", "slope", F.max("slope").over(w).alias("horizon"))
    vis = F.when(F.col("horizon").isNull() | (F.col("slope") >= F.col("horizon")), 1).otherwise(0)
    here = obs.select("id", F.col("ox").cast("bigint").alias("gx"), F.col("oy").cast("bigint").alias("gy"), F.lit(1).alias("vis"))
    return (
        seen.groupBy("id", "sector", "gx", "gy").agg(F.max(vis).alias("vis")).drop("sector")
        .unionByName(here)
        .groupBy("id", "gx", "gy")
        .agg(F.max("vis").alias("vis"))
    )


def viewshed_exact(obs: DataFrame, cells: DataFrame, prune_grid: Grid | None = None) -> DataFrame:
    """V3: a ray to every valid target within the Chebyshev radius; at each major-axis
    step the terrain is interpolated linearly between the two straddled cells.
    Cost ~R^3 per observer: for small radii and checks.  ``prune_grid``: the layer's layout; only cells of the tiles
    that some observer's square touches are read further."""
    valid = cells.where(F.col("value").isNotNull()).select("gx", "gy", "value")
    if prune_grid is not None:
        side = F.floor(2 * F.col("radius") / min(prune_grid.tile_cols, prune_grid.tile_rows)) + 2
        valid = prune_to_tiles(valid, observer_tile_keys(obs, prune_grid), prune_grid, row_bound(obs, side * side))
    t = obs.select("id", "ox", "oy", "oz", "radius", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias("dx"))
    t = t.select("*", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias("dy")).where("dx != 0 OR dy != 0")
    t = t.select(
        "id", "ox", "oy", "oz", "dx", "dy",
        (F.col("ox") + F.col("dx")).cast("bigint").alias("gx"),
        (F.col("oy") + F.col("dy")).cast("bigint").alias("gy"),
        F.greatest(F.abs("dx"), F.abs("dy")).alias("m"),
    )
    targets = t.join(valid, ["gx", "gy"]).select(
        "id", "ox", "oy", "oz", "dx", "dy", "m", "gx", "gy",
        ((F.col("value") - F.col("oz")) / F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))).alias("tslope"),
    )
    # intermediate samples k = 1..m-1, each touching one or two cells
    st = targets.where("m > 1").select(
        "id", "gx", "gy", "ox", "oy", "oz", "dx", "dy", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    )
    xmaj = F.abs("dx") >= F.abs("dy")
    minor_d = F.when(xmaj, F.col("dy")).otherwise(F.col("dx"))
    major_d = F.when(xmaj, F.col("dx")).otherwise(F.col("dy"))
    num = F.col("k") * minor_d  # minor offset = num / m
    lo = F.floor(num.cast("double") / F.col("m").cast("double")).cast("int")
    frac = (num - lo * F.col("m")).cast("double") / F.col("m").cast("double")
    kmaj = F.signum(major_d).cast("int") * F.col("k")
    st = st.select(
        "id", "gx", "gy", "ox", "oy", "oz", "k", xmaj.alias("xmaj"), kmaj.alias("kmaj"), lo.alias("lo"), frac.alias("frac"),
        F.sqrt((F.col("k") * F.col("k")).cast("double") + F.pow(num.cast("double") / F.col("m").cast("double"), 2)).alias("dist"),
    )
    two = st.select(
        "*",
        F.explode(
            F.when(F.col("frac") == 0, F.array(F.struct(F.lit(0).alias("o"), F.lit(1.0).alias("w")))).otherwise(
                F.array(
                    F.struct(F.lit(0).alias("o"), (1 - F.col("frac")).alias("w")),
                    F.struct(F.lit(1).alias("o"), F.col("frac").alias("w")),
                )
            )
        ).alias("p"),
    )
    cx = F.when(F.col("xmaj"), F.col("ox") + F.col("kmaj")).otherwise(F.col("ox") + F.col("lo") + F.col("p.o"))
    cy = F.when(F.col("xmaj"), F.col("oy") + F.col("lo") + F.col("p.o")).otherwise(F.col("oy") + F.col("kmaj"))
    two = two.select(
        F.col("id"), F.col("gx").alias("tx"), F.col("gy").alias("ty"), "k", "oz", "dist", F.col("p.w").alias("w"),
        F.col("p.o").alias("o"), cx.cast("bigint").alias("gx"), cy.cast("bigint").alias("gy"),
        F.when(F.col("frac") == 0, 1).otherwise(2).alias("expect"),
    )
    z = two.join(valid, ["gx", "gy"]).groupBy("id", "tx", "ty", "k", "oz", "dist", "expect").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("o") == 0, F.col("value") * F.col("w"))).alias("z0"),
        F.sum(F.when(F.col("o") == 1, F.col("value") * F.col("w"))).alias("z1"),
    )
    # every straddled cell must be valid for an interpolated sample to block
    zz = F.col("z0") + F.coalesce(F.col("z1"), F.lit(0.0))
    z = z.where(F.col("n") == F.col("expect"))
    horizon = z.select("id", "tx", "ty", ((zz - F.col("oz")) / F.col("dist")).alias("s")).groupBy("id", "tx", "ty").agg(
        F.max("s").alias("horizon")
    )
    res = targets.select("id", "gx", "gy", "tslope").join(
        horizon.withColumnRenamed("tx", "gx").withColumnRenamed("ty", "gy"), ["id", "gx", "gy"], "left"
    )
    vis = F.when(F.col("horizon").isNull() | (F.col("tslope") >= F.col("horizon")), 1).otherwise(0)
    here = obs.select("id", F.col("ox").cast("bigint").alias("gx"), F.col("oy").cast("bigint").alias("gy"), F.lit(1).alias("vis"))
    return res.select("id", "gx", "gy", vis.alias("vis")).unionByName(here)


# --- V4: ring by ring ------------------------------------------------------------------

#: observers that share a window, and cells of their results that a task holds at once
MEMBERS = 64
RESULT_CELLS = 1 << 22
#: cells of a window (8 bytes each); a larger one fails with a message
WINDOW_CELLS = 1 << 28


def _ring_looks(z: np.ndarray, ox: np.ndarray, oy: np.ndarray, oz: np.ndarray, own: np.ndarray | None, reach: np.ndarray, tile: tuple[int, int]) -> np.ndarray:
    """1 / 0 / -1 (visible, hidden, no cell) for every cell of the window ``z`` (NaN = NODATA) and observer (``n x rows x cols``).

    ``own``: per observer, which tiles of the window it sees; ``reach``: its radius.  On each of the four sides of ring k
    the cell at offset t looks through ring k - 1 at offset t (k - 1) / k: between two cells there, or at one of them.  Only
    offsets that the window holds are looked at; the offsets they look through lie nearer to the axis."""
    n, (rows, cols) = len(ox), z.shape
    out = np.full((n, rows, cols), -1, np.int8)
    here = (oy >= 0) & (oy < rows) & (ox >= 0) & (ox < cols)
    out[np.flatnonzero(here), oy[here], ox[here]] = 1
    last = int(min(reach.max(), max(ox.max(), cols - 1 - ox.min(), oy.max(), rows - 1 - oy.min())))
    # sides: axis that grows with the ring, its direction, offsets of the other axis that the window holds
    sides = [(0, 1, -oy.max(), rows - 1 - oy.min()), (0, -1, -oy.max(), rows - 1 - oy.min()), (1, 1, -ox.max(), cols - 1 - ox.min()), (1, -1, -ox.max(), cols - 1 - ox.min())]
    for axis, sign, least, most in sides:
        horizon, begin = np.full((n, 1), -np.inf), 0
        furthest = (cols - 1 - ox.min() if sign > 0 else ox.max()) if axis == 0 else (rows - 1 - oy.min() if sign > 0 else oy.max())
        for k in range(1, min(last, int(furthest)) + 1):
            t = np.arange(max(-k, least), min(k, most) + 1)
            if not len(t):
                break
            low = t * (k - 1) // k
            rest = t * (k - 1) - low * k
            a, b = horizon[:, low - begin], horizon[:, low - begin + (rest > 0)]
            f = rest / k
            with np.errstate(invalid="ignore"):
                inner = np.where(np.isneginf(a), b, np.where(np.isneginf(b), a, a * (1 - f) + b * f))
            inner = np.where(rest == 0, a, inner)
            x = (ox[:, None] + sign * k + 0 * t) if axis == 0 else ox[:, None] + t
            y = oy[:, None] + t if axis == 0 else (oy[:, None] + sign * k + 0 * t)
            inside = (x >= 0) & (x < cols) & (y >= 0) & (y < rows) & (reach[:, None] >= k)
            cx, cy = np.where(inside, x, 0), np.where(inside, y, 0)
            if own is not None:
                inside &= own[np.arange(n)[:, None], cy // tile[0], cx // tile[1]]
            value = np.where(inside, z[cy, cx], np.nan)
            slope = (value - oz[:, None]) / np.sqrt((k * k + t * t).astype(float))
            who, at = np.nonzero(~np.isnan(value))
            out[who, cy[who, at], cx[who, at]] = slope[who, at] >= inner[who, at]
            horizon, begin = np.fmax(inner, slope), int(t[0])
    return out


def binary_median(vis: np.ndarray) -> np.ndarray:
    """F5 of 1 / 0 / -1 masks (``n x rows x cols``): with ``ones`` of ``n`` valid cells of the window, the median is 1 if
    2 ones > n, 0.5 if 2 ones = n, else 0; NaN where the cell has no value."""
    def boxes(x: np.ndarray) -> np.ndarray:
        p = np.pad(x.astype(np.int8), ((0, 0), (1, 1), (1, 1)))
        p = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
        return p[:, :, :-2] + p[:, :, 1:-1] + p[:, :, 2:]

    valid = vis >= 0
    ones, n = boxes(vis == 1), boxes(valid)
    return np.where(valid, np.where(2 * ones > n, 1.0, np.where(2 * ones == n, 0.5, 0.0)), np.nan)


def viewshed_approx(obs: DataFrame, tiles: DataFrame, grid: Grid, median: bool = False) -> DataFrame:
    """V4: ``(id, col, row, data)``, per observer the tiles of its answers: 1 visible, 0 hidden, NULL for NODATA.

    ``obs``: ``(id, ox, oy, oz)`` and either ``radius`` (cells up to that Chebyshev distance) or ``px, py, buff`` (all cells of
    the tiles that touch the disk, G7).  Every valid cell has an answer, the observer's own is always 1.  ``median`` returns
    the 3x3 median (F5) of the answers instead."""
    tc, tr = grid.tile_cols, grid.tile_rows
    buffered = "buff" in obs.columns
    group = ["gc", "gr", "chunk"]
    o = obs.withColumns({"gc": F.floor(F.col("ox") / tc).cast("int"), "gr": F.floor(F.col("oy") / tr).cast("int")})
    crowd = o.groupBy("gc", "gr").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("chunks"))
    o = o.join(crowd, ["gc", "gr"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    o = o.select(*group, "id", "ox", "oy", "oz", *(["px", "py", "buff"] if buffered else ["radius"]))
    if buffered:
        wanted = tiles_within(o.withColumnsRenamed({"px": "x", "py": "y"}), grid, carry=tuple(group))
    else:
        wanted = observer_tile_keys(o, grid, tuple(group))
    shared = wanted.select(*group, "col", "row").distinct().join(tiles.select("col", "row", F.col("data").cast("array<double>").alias("data")), ["col", "row"])
    rows = grouped(o.withColumn("kind", F.lit(0)).unionByName(shared.withColumn("kind", F.lit(1)), allowMissingColumns=True), group, ["kind", "row", "col"])
    schema = T.StructType([obs.schema["id"], *(T.StructField(c, T.IntegerType()) for c in ("col", "row")), T.StructField("data", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in whole_groups(batches, group):
            for lo, hi in zip(np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), np.flatnonzero(np.r_[number[1:] != number[:-1], True]) + 1, strict=True):
                part = t.slice(lo, hi - lo).combine_chunks()
                kind = part.column("kind").to_numpy()
                yield from _window(part.filter(pa.array(kind == 0)), part.filter(pa.array(kind == 1)), grid, buffered, median, arrow)

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def _window(members: pa.Table, held: pa.Table, grid: Grid, buffered: bool, median: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Answers of the observers of one group from its tiles."""
    tc, tr = grid.tile_cols, grid.tile_rows
    ox, oy, oz = (members.column(c).to_numpy() for c in ("ox", "oy", "oz"))
    col, row = (held.column(c).to_numpy().astype(np.int64) for c in ("col", "row"))
    c0, r0 = (int(np.r_[v, own].min()) for v, own in ((col, ox // tc), (row, oy // tr)))
    c1, r1 = (int(np.r_[v, own].max()) + 1 for v, own in ((col, ox // tc), (row, oy // tr)))
    if (c1 - c0) * (r1 - r0) * tc * tr > WINDOW_CELLS:
        raise ValueError(f"an observer's window of {c1 - c0} x {r1 - r0} tiles is larger than {WINDOW_CELLS} cells; use viewshed_r2")
    z = np.full((r1 - r0, c1 - c0, tr, tc), np.nan)
    z[row - r0, col - c0] = dense(held.column("data").combine_chunks(), tc * tr).reshape(-1, tr, tc)
    z = z.transpose(0, 2, 1, 3).reshape((r1 - r0) * tr, (c1 - c0) * tc)
    keys = np.stack(np.meshgrid(np.arange(r0, r1), np.arange(c0, c1), indexing="ij"))
    if buffered:
        px, py, buff = (members.column(c).to_numpy()[:, None, None] for c in ("px", "py", "buff"))
        w, h = tc * grid.cell_w, tr * grid.cell_h
        xmin, ymax = grid.xmin + keys[1] * w, grid.ymax - keys[0] * h
        dx = np.maximum(np.maximum(xmin - px, 0.0), px - (xmin + w))
        dy = np.maximum(np.maximum((ymax - h) - py, 0.0), py - ymax)
        own, reach = dx * dx + dy * dy <= buff * buff, np.full(len(ox), max(z.shape))
    else:
        own, reach = None, members.column("radius").to_numpy().astype(np.int64)
    x, y = ox - c0 * tc, oy - r0 * tr
    step = max(1, RESULT_CELLS // z.size)
    for lo in range(0, len(ox), step):
        part = slice(lo, lo + step)
        vis = _ring_looks(z, x[part], y[part], oz[part], None if own is None else own[part], reach[part], (tr, tc))
        data = binary_median(vis) if median else np.where(vis >= 0, vis, np.nan)
        data = data.reshape(-1, r1 - r0, tr, c1 - c0, tc).transpose(0, 1, 3, 2, 4).reshape(-1, r1 - r0, c1 - c0, tr * tc)
        who, rr, cc = np.nonzero(~np.isnan(data).all(axis=3))
        values = data[who, rr, cc].reshape(-1)
        offsets = pa.array(np.arange(0, len(values) + 1, tr * tc, dtype=np.int32))
        arrays = [
            members.column("id").combine_chunks().take(pa.array(who + lo)), pa.array((cc + c0).astype(np.int32)), pa.array((rr + r0).astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(values, mask=np.isnan(values))),
        ]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def tiles_within(obs_xy: DataFrame, grid: Grid, buff_col: str = "buff", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *carry, col, row)`` of the tiles whose rectangle touches the disk of radius
    ``buff`` around each observer (whole tiles, not clipped).  Key bounding box
    first, then the exact point-rectangle distance."""
    tw = grid.tile_cols * grid.cell_w
    th = grid.tile_rows * grid.cell_h
    b = obs_xy.select(
        "id", *carry, "x", "y", F.col(buff_col).alias("buff"),
        F.floor((F.col("x") - F.col(buff_col) - grid.xmin) / tw).cast("int").alias("c0"),
        F.floor((F.col("x") + F.col(buff_col) - grid.xmin) / tw).cast("int").alias("c1"),
        F.floor((grid.ymax - F.col("y") - F.col(buff_col)) / th).cast("int").alias("r0"),
        F.floor((grid.ymax - F.col("y") + F.col(buff_col)) / th).cast("int").alias("r1"),
    )
    k = b.select("id", *carry, "x", "y", "buff", "r0", "r1", F.explode(F.sequence("c0", "c1")).alias("col"))
    k = k.select("id", *carry, "x", "y", "buff", "col", F.explode(F.sequence("r0", "r1")).alias("row"))
    d2 = point_rect_dist2(F.col("x"), F.col("y"), tile_extent(grid, "col", "row"))
    return k.where(d2 <= F.col("buff") * F.col("buff")).select("id", *carry, "col", "row")


def observer_viewshed(observers: DataFrame, dem: DataFrame, surface: DataFrame, grid: Grid, median: bool = False) -> DataFrame:
    """V5: observer height from the DEM (cells), visibility over the packed surface model (DSM) of all tiles within ``buff`` of
    each observer, whatever ``radius`` it carries.  The observer's surface cell counts as its elevation (L8): it is always
    visible and no line of sight passes through it.  ``(id, col, row, data)`` as :func:`viewshed_approx`."""
    o = observers.select("id", "x", "y", "height", F.lit(1).alias("radius"), F.col("x").alias("px"), F.col("y").alias("py"), "buff")
    obs = cut_lineage(observer_cells(o, dem, grid, carry=("px", "py", "buff")).drop("radius"))
    return viewshed_approx(obs, surface, grid, median)
