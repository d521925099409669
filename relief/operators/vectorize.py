"""Raster regions -> polygons.

Z1 labels connected equal-valued, non-NODATA cells (4-neighbour).  Region id =
the smallest cell id ``gy * 2^32 + gx`` in the region.

Plan, on packed tiles throughout (a tile is the bounded unit of work):
  1. ``tile_runs``: an Arrow pass turns each tile into maximal horizontal runs
     of equal valid values and labels the tile's connected runs; no shuffle;
  2. only the runs on tile borders meet their neighbours in the next tile, by an
     equi-join on (keys, gx, gy, value);
  3. the labels that touch go to alternating large-star / small-star rounds
     (Kiveris et al., 2014).  Each round is a few joins and aggregates written to a
     table in the session's checkpoint folder, so a lost executor recomputes at
     most one round.
Z2 never looks at single cells: the corners of a region's outline are the points
where the signed ends of its runs in two neighbouring rows don't cancel; along
each line of the grid they pair up to the outline's straight edges.  Edges are
chained inside blocks of the grid, the chains that leave a block in the blocks
of the next size, and so on until every chain is closed: a ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relief.operators import tiles as tl
from relief.operators.stream import grouped, lists, whole_groups
from relief.schema import Grid
from relief.session import ensure_checkpoint_dir, stored

SHIFT = 4294967296  # 2^32: cell id = gy * 2^32 + gx


# --- Z1: runs and regions ------------------------------------------------------------


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of every node's connected component."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        low = np.minimum(a, b)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        apart = parent[u] != parent[v]
        u, v = u[apart], v[apart]
    return parent


def runs_of_tiles(data: np.ndarray, col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of tiles (``k x rows x cols``, NaN = NODATA): tile, gy, gx0, gx1, value, label (least cell id of the tile's
    connected runs)."""
    k, tr, tc = data.shape
    valid = ~np.isnan(data)
    start = valid.copy()
    start[:, :, 1:] &= ~(valid[:, :, :-1] & (data[:, :, 1:] == data[:, :, :-1]))
    run = np.cumsum(start.reshape(-1)).reshape(data.shape) - 1
    tile, y, x0 = np.nonzero(start)
    size = np.bincount(run[valid], minlength=len(tile))
    gy, gx0 = row[tile] * tr + y, col[tile] * tc + x0
    touch = valid[:, 1:] & valid[:, :-1] & (data[:, 1:] == data[:, :-1])
    pairs = np.unique(np.stack([run[:, 1:][touch], run[:, :-1][touch]]), axis=1)
    least = _labels(len(tile), pairs[0], pairs[1])  # runs are numbered row by row inside a tile: the least has the least id
    return tile, gy, gx0, gx0 + size - 1, data[tile, y, x0], gy[least] * SHIFT + gx0[least]


def tile_runs(tiles: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, gy, gx0, gx1, value, label)``: maximal horizontal runs of every tile; ``label`` is equal for the tile's runs
    that touch."""
    k = list(keys)
    schema = T.StructType(
        [tiles.schema[c] for c in k]
        + [T.StructField(c, T.LongType()) for c in ("gy", "gx0", "gx1")]
        + [T.StructField("value", T.DoubleType()), T.StructField("label", T.LongType())]
    )
    tc, tr = grid.tile_cols, grid.tile_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tl.few_tiles(batches, grid):
            data = tl.dense(rb.column("data"), tc * tr).reshape(-1, tr, tc)
            tile, *parts = runs_of_tiles(data, rb.column("col").to_numpy().astype(np.int64), rb.column("row").to_numpy().astype(np.int64))
            own = [rb.column(c).take(pa.array(tile)) for c in k]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, parts)], schema=arrow)

    arrow = to_arrow_schema(schema)
    return tiles.select(*k, "col", "row", F.col("data").cast("array<double>").alias("data")).mapInArrow(run, schema)


def _border_links(runs: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """``(*keys, u, v)``, u > v: labels of runs that touch across a tile border."""

    def cells(at_border, gx0: str, gx1: str, dx: int, dy: int) -> DataFrame:
        x = F.explode(F.sequence(F.col(gx0) + dx, F.col(gx1) + dx))
        return runs.where(at_border).select(*keys, x.alias("gx"), (F.col("gy") + dy).alias("gy"), "value", "label")

    tc, tr = grid.tile_cols, grid.tile_rows
    right, left = F.pmod(F.col("gx1") + 1, F.lit(tc)) == 0, F.pmod(F.col("gx0"), F.lit(tc)) == 0
    bottom, top = F.pmod(F.col("gy") + 1, F.lit(tr)) == 0, F.pmod(F.col("gy"), F.lit(tr)) == 0
    # the cell east of a right border, the cells south of a bottom border
    sent = cells(right, "gx1", "gx1", 1, 0).withColumn("side", F.lit(0)).unionByName(cells(bottom, "gx0", "gx1", 0, 1).withColumn("side", F.lit(1)))
    here = cells(left, "gx0", "gx0", 0, 0).withColumn("side", F.lit(0)).unionByName(cells(top, "gx0", "gx1", 0, 0).withColumn("side", F.lit(1)))
    j = sent.join(here.withColumnRenamed("label", "other"), [*keys, "side", "gx", "gy", "value"])
    return j.select(*keys, F.greatest("label", "other").alias("u"), F.least("label", "other").alias("v")).where("u != v").distinct()


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    j = both.join(m, keys + ["u"]).where(F.col("v") > F.col("u"))
    out = j.select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
    return out.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    # e holds (u, v) with v < u: v is u's smaller neighbour
    m = e.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    j = e.join(m, keys + ["u"])
    out = j.select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        m.select(*keys, F.col("u").alias("a"), F.col("m").alias("b"))
    )
    return out.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()


def components(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 200) -> DataFrame:
    """``(*keys, u, label)``: min-label of every vertex that has an edge.

    Stops when the edges are stars: every leaf has one centre, and no centre is a
    leaf.  A leaf with two centres still joins two stars, so both are needed."""
    k = list(keys)
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = stored(edges.select(*k, "u", "v"))
    for _ in range(max_rounds):
        e = stored(_small_star(_large_star(e, k), k))
        # per vertex: how often it is a leaf, and whether it is a centre
        ends = e.select(*k, "u", F.lit(1).alias("n"), F.lit(0).alias("c")).unionByName(e.select(*k, F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("c")))
        if ends.groupBy(*k, "u").agg(F.sum("n").alias("n"), F.max("c").alias("c")).where("n > 1 or (n > 0 and c > 0)").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(*k, "u", F.col("v").alias("label"))


def region_runs(tiles: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """Z1 on packed tiles: ``(*keys, gy, gx0, gx1, value, region)``, the runs of every region."""
    k = list(keys)
    runs = stored(tile_runs(tiles, grid, keys))
    links = stored(_border_links(runs, grid, k))
    if links.isEmpty():
        return runs.withColumnRenamed("label", "region")
    joined = components(links, keys).select(*k, F.col("u").alias("label"), F.col("label").alias("least"))
    return runs.join(joined, [*k, "label"], "left").select(*k, "gy", "gx0", "gx1", "value", F.coalesce("least", "label").alias("region"))


def regions(cells: DataFrame, keys: tuple[str, ...] = (), segment: int = 256) -> DataFrame:
    """``(*keys, gx, gy, value, region)`` for every valid cell.  The cells are packed into tiles of ``segment`` cells a side."""
    k = list(keys)
    grid = Grid(0.0, 0.0, 1.0, 1.0, segment, segment)
    valid = cells.where(F.col("value").isNotNull()).select(*k, "gx", "gy", F.col("value").cast("double").alias("value"))
    r = region_runs(tl.pack(valid, grid, keys), grid, keys)
    return r.select(*k, F.explode(F.sequence("gx0", "gx1")).alias("gx"), "gy", "value", "region")


def region_summary(labelled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, region, value, cells)`` from labelled cells or runs."""
    size = F.col("gx1") - F.col("gx0") + 1 if "gx1" in labelled.columns else F.lit(1)
    return labelled.groupBy(*keys, "region").agg(F.first("value").alias("value"), F.sum(size).cast("bigint").alias("cells"))


# --- Z2: outlines -> rings -------------------------------------------------------------

EAST, SOUTH, WEST, NORTH = range(4)


def outline_edges(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Straight edges ``(*keys, region, value, x0, y0, dir, x1, y1)`` (grid corners) of each region's outline, with the region
    on the right when walking (gy south): along the top of a cell to the east.

    A run adds +1 at the start and -1 at the end of its top side, and the opposite on its bottom side.  Where the sum at a
    point is not 0, the outline turns.  On every row line, and on every column line, the running sum tells the side on which
    the region lies: 0 inside, outside and on straight stretches."""
    k = [*keys, "region", "value"]

    def end(y, x, sign: int):
        return F.struct(y.alias("y"), x.alias("x"), F.lit(sign).alias("s"))

    top, bottom, start, stop = F.col("gy"), F.col("gy") + 1, F.col("gx0"), F.col("gx1") + 1
    ends = F.array(end(top, start, 1), end(top, stop, -1), end(bottom, start, -1), end(bottom, stop, 1))
    corners = runs.select(*k, F.inline(ends)).groupBy(*k, "y", "x").agg(F.sum("s").alias("s")).where("s != 0")

    def along(line: str, pos: str, ahead: int, back: int) -> DataFrame:
        """Edges on the lines of one direction; a running sum of 1 walks ``ahead``."""
        w = Window.partitionBy(*k, line).orderBy(pos)
        state = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
        e = corners.select(*k, line, pos, F.lead(pos).over(w).alias("to"), state.alias("state")).where("state != 0")
        forth = (F.col("state") > 0) if ahead == EAST else (F.col("state") < 0)
        a, b = F.when(forth, F.col(pos)).otherwise(F.col("to")), F.when(forth, F.col("to")).otherwise(F.col(pos))
        turn = F.when(forth, F.lit(ahead)).otherwise(F.lit(back)).alias("dir")
        if line == "y":
            return e.select(*k, a.alias("x0"), F.col("y").alias("y0"), turn, b.alias("x1"), F.col("y").alias("y1"))
        return e.select(*k, F.col("x").alias("x0"), a.alias("y0"), turn, F.col("x").alias("x1"), b.alias("y1"))

    return along("y", "x", EAST, WEST).unionByName(along("x", "y", SOUTH, NORTH))


def link(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, first: np.ndarray, x1: np.ndarray, y1: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which chain of its group goes on where each chain ends (-1: none).  ``first`` and ``last`` are directions.  Where two
    chains begin at one point, the right turn is taken, so that rings never cross."""
    starts = np.rec.fromarrays([group, y0, x0, first])
    order = np.argsort(starts)
    held = starts[order]
    out = np.full(len(group), -1)
    for turn in (1, 3):
        todo = np.flatnonzero(out < 0)
        want = np.rec.fromarrays([group[todo], y1[todo], x1[todo], (last[todo] + turn) % 4], dtype=starts.dtype)
        at = np.minimum(np.searchsorted(held, want), len(held) - 1)
        hit = held[at] == want
        out[todo[hit]] = order[at[hit]]
    return out


def follow(nxt: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Open chains and closed ones, as lists of places."""
    after = nxt.tolist()
    entered = np.zeros(len(nxt), bool)
    entered[nxt[nxt >= 0]] = True
    seen = [False] * len(after)
    found: tuple[list[list[int]], list[list[int]]] = ([], [])
    for closed, begins in ((0, np.flatnonzero(~entered).tolist()), (1, range(len(after)))):
        for k in begins:
            if seen[k]:
                continue
            way = []
            while k >= 0 and not seen[k]:
                seen[k] = True
                way.append(k)
                k = after[k]
            found[closed].append(way)
    return found


def _chain_blocks(chains: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Chains linked inside blocks of ``size`` grid corners, by their starts; closed ones are marked."""
    k = [*keys, "region", "value"]
    schema = T.StructType([*chains.schema.fields])
    names = schema.names
    groups = [*keys, "region", "_by", "_bx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, groups):
            x0, y0, first, x1, y1, last = (t.column(c).to_numpy() for c in ("x0", "y0", "dir", "x1", "y1", "last"))
            ends, xs, ys = t.column("xs").combine_chunks().offsets.to_numpy(), t.column("xs").combine_chunks().flatten().to_numpy(), t.column("ys").combine_chunks().flatten().to_numpy()
            opened, rings = follow(link(group, x0, y0, first, x1, y1, last))
            ways = opened + rings
            if not ways:
                continue
            head, tail = np.array([w[0] for w in ways]), np.array([w[-1] for w in ways])
            places = [np.concatenate([np.arange(ends[p], ends[p + 1]) for p in w]) for w in ways]
            closed = np.arange(len(ways)) >= len(opened)
            cols = {
                **{c: t.column(c).combine_chunks().take(pa.array(head)) for c in k},
                "x0": pa.array(x0[head]), "y0": pa.array(y0[head]), "dir": pa.array(first[head]),
                "x1": pa.array(x1[tail]), "y1": pa.array(y1[tail]), "last": pa.array(last[tail]), "closed": pa.array(closed),
                "xs": lists([xs[p] for p in places], pa.int64()), "ys": lists([ys[p] for p in places], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([cols[c].cast(arrow.field(c).type) for c in names], schema=arrow)

    arrow = to_arrow_schema(schema)
    dealt = chains.withColumns({"_by": F.floor(F.col("y0") / size), "_bx": F.floor(F.col("x0") / size)})
    return grouped(dealt, groups, ["y0", "x0", "dir"]).mapInArrow(run, schema)


def closed_chains(edges: DataFrame, keys: tuple[str, ...] = (), block: int = 256) -> DataFrame:
    """``(*keys, region, value, xs, ys)``: the corners of every ring in walking order, from any of them.

    A round links the chains that begin in one block of the grid; the blocks' side grows fourfold.  Rings leave in the round
    that closes them, so a late round holds only what is longer than the blocks before."""
    k = [*keys, "region", "value"]
    corner = [F.array("x0").alias("xs"), F.array("y0").alias("ys")]
    chains = edges.select(*k, "x0", "y0", "dir", "x1", "y1", F.col("dir").alias("last"), F.lit(False).alias("closed"), *corner)
    rings = None
    while True:
        chains = stored(_chain_blocks(chains, list(keys), block))
        done = chains.where("closed").select(*k, "xs", "ys")
        rings = done if rings is None else rings.unionByName(done)
        chains = chains.where("not closed")
        if chains.isEmpty():
            return rings
        block *= 4


def region_rings(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, region, value, ring, hole, xs, ys)`` in grid-corner units, from labelled runs or cells.  Ring 0 is the
    outer ring (a 4-connected region has exactly one), the others are holes, larger ones first, equal ones by their least
    corner.  A ring begins and ends at its least (y, x) corner."""
    w = Window.partitionBy(*keys, "region").orderBy(F.desc("area"), "y", "x")
    r = _measured(runs, keys).withColumn("ring", F.row_number().over(w) - 1)
    return r.select(*keys, "region", "value", F.col("ring").cast("int"), (F.col("ring") > 0).alias("hole"), "xs", "ys")


def _measured(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Closed rings from their least corner on, with it (``y, x``) and the area."""
    if "gx1" not in runs.columns:
        runs = runs.select(*keys, "region", "value", "gy", F.col("gx").alias("gx0"), F.col("gx").alias("gx1"))
    rings = closed_chains(outline_edges(runs, keys), keys)
    schema = T.StructType([*rings.schema.fields, T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("area", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ends, xs, ys = rb.column("xs").offsets.to_numpy(), rb.column("xs").flatten().to_numpy(), rb.column("ys").flatten().to_numpy()
            base = ends[0]
            out, area = ([], []), np.zeros(rb.num_rows)
            for r, (lo, hi) in enumerate(zip((ends[:-1] - base).tolist(), (ends[1:] - base).tolist(), strict=True)):
                x, y = xs[lo:hi], ys[lo:hi]
                at = int(np.lexsort((x, y))[0])
                x, y = np.r_[x[at:], x[: at + 1]], np.r_[y[at:], y[: at + 1]]
                dx, dy = x - x[0], y - y[0]
                area[r] = abs(int((dx[:-1] * dy[1:] - dx[1:] * dy[:-1]).sum())) / 2
                out[0].append(x)
                out[1].append(y)
            cols = {c: rb.column(c) for c in rb.schema.names} | {"xs": lists(out[0], pa.int64()), "ys": lists(out[1], pa.int64()), "area": pa.array(area)}
            cols |= {"y": pa.array([int(v[0]) for v in out[1]], pa.int64()), "x": pa.array([int(v[0]) for v in out[0]], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c].cast(arrow.field(c).type) for c in names], schema=arrow)

    arrow = to_arrow_schema(schema)
    return rings.mapInArrow(run, schema)


def region_polygons(runs: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """Z2+Z3: one GeoJSON Feature per region, map coordinates, ``value`` property, from labelled runs or cells.

    Result ``(*keys, region, value, geojson)``; a region's polygon is one value and has to fit one row."""
    k = list(keys)
    coords = F.transform(
        F.arrays_zip("xs", "ys"),
        lambda p: F.array(F.lit(grid.xmin) + p["xs"] * grid.cell_w, F.lit(grid.ymax) - p["ys"] * grid.cell_h),
    )
    one = F.struct((-F.col("area")).alias("a"), "y", "x", coords.alias("c"))
    poly = _measured(runs, keys).groupBy(*k, "region", "value").agg(F.array_sort(F.collect_list(one)).alias("rs"))
    geom = F.struct(F.lit("Polygon").alias("type"), F.transform("rs", lambda x: x["c"]).alias("coordinates"))
    feat = F.struct(
        F.lit("Feature").alias("type"), geom.alias("geometry"), F.struct(F.col("value").alias("value")).alias("properties")
    )
    return poly.select(*k, "region", "value", F.to_json(feat).alias("geojson"))
