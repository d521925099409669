"""Products by name over any packed layer.

``product(name, tiles, grid, **params)`` turns tiles ``(layer, zoom, col, row, data)`` into tiles of the same keys
and layout.  A product is a list of steps on whole tiles: local ones (a cell by itself), focal ones (3x3, each needs
one cell more around the tile) and tile-wise ones.  The composer adds up how wide a halo
the steps need, exchanges it once, and runs all steps in one Arrow pass over the padded tiles: between the
steps nothing is unpacked, shuffled or written.  Without a halo there is no shuffle at all.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relief.functions import color as Y
from relief.functions import local as L
from relief.functions.kernels import kernel_np
from relief.operators.tiles import ROLES, few_tiles, halo, list_column, padded
from relief.operators.zonal import quantile_ranks
from relief.schema import Grid

KEYS = ("layer", "zoom", "col", "row")


@dataclass
class Tiles:
    """What a step works on: the values so far, with ``pad`` cells around each tile, and what they came from."""

    value: np.ndarray
    pad: int
    source: dict[str, np.ndarray]  # the input layers, with the first halo around
    halo: int
    zoom: np.ndarray  # of each tile
    carried: dict[str, np.ndarray]  # further columns, of each tile

    def origin(self, name: str = "data") -> np.ndarray:
        """An input layer, cut to the padding that is left."""
        cut = self.halo - self.pad
        whole = self.source[name]
        return whole[:, cut : whole.shape[1] - cut, cut : whole.shape[2] - cut]

    def by_zoom(self, f: Callable[[int], float]) -> np.ndarray:
        """A number per tile from its zoom."""
        known = {z: f(int(z)) for z in np.unique(self.zoom).tolist()}
        return np.array([known[z] for z in self.zoom.tolist()], float)[:, None, None]


Step = Callable[[Tiles], np.ndarray]


@dataclass(frozen=True)
class Plan:
    """Steps and the cells of halo that each uses up; the type of the result; other input layers by column."""

    steps: list[tuple[Step, int]]
    kind: T.DataType = field(default_factory=T.LongType)
    layers: tuple[str, ...] = ()

    @property
    def halo(self) -> int:
        return sum(width for _, width in self.steps)


# --- steps -------------------------------------------------------------------------------


def local(f: Callable[[np.ndarray], np.ndarray]) -> tuple[Step, int]:
    return lambda t: f(t.value), 0


def focal(op: str, **params) -> tuple[Step, int]:
    return lambda t: kernel_np(op, t.value, **params), 1


def exaggerate(kind: str) -> tuple[Step, int]:
    """L3, by each tile's zoom."""
    return lambda t: t.value * t.by_zoom(lambda z: L.exaggeration_factor(z, kind)), 0


def contour(integer_layer: bool) -> tuple[Step, int]:
    """L4, by each tile's zoom; an unknown zoom gives NODATA."""

    def run(t: Tiles) -> np.ndarray:
        q = t.value / t.by_zoom(lambda z: L.CONTOUR_INTERVAL.get(z, np.nan))
        return np.trunc(q) if integer_layer else q

    return run, 0


def normalize(old_min: float, old_max: float, new_min: float, new_max: float) -> tuple[Step, int]:
    """L5, truncated to whole numbers."""
    return local(lambda v: np.trunc((v - old_min) * (new_max - new_min) / (old_max - old_min) + new_min))


def masked(fill: float = 0.0) -> tuple[Step, int]:
    """``fill`` where the input layer is NODATA."""
    return lambda t: np.where(np.isnan(t.origin()), fill, t.value), 0


def classes(definition: str, at_least: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Y1 (first class with v <= limit), or Y2 (last with v >= limit); outside, the nearest end's colour; NODATA 0."""
    entries = Y.color_entries(definition)
    if entries is None:
        return lambda v: np.full(v.shape, np.nan)
    limits, colors = (np.array(x, float) for x in zip(*entries, strict=True))

    def run(v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(limits, v, side="right") - 1 if at_least else np.searchsorted(limits, v, side="left")
        return np.where(np.isnan(v), 0.0, colors[np.clip(at, 0, len(limits) - 1)])

    return run


def ranks(stops: int) -> tuple[Step, int]:
    """K5: equal-count class of every cell within its tile."""
    return lambda t: quantile_ranks(t.value.reshape(len(t.value), -1), stops).reshape(t.value.shape), 0


def greys(stops: int) -> tuple[Step, int]:
    """Y3 of class numbers; NODATA 0."""

    def run(v: np.ndarray) -> np.ndarray:
        g = np.floor((v * 510 + stops) / (2 * stops))
        return np.where(np.isnan(v), 0.0, g * 16777216 + g * 65536 + g * 256 + 255)

    return local(run)


def shaded(definition: str) -> tuple[Step, int]:
    """The input layer's colours darkened by the shade so far; NODATA where there is no shade."""
    color = classes(definition)

    def run(t: Tiles) -> np.ndarray:
        base = color(t.origin())
        known = ~(np.isnan(t.value) | np.isnan(base))
        argb, delta = np.where(known, base, 0).astype(np.int64), 255 - np.where(known, t.value, 0).astype(np.int64)
        channel = lambda shift: np.maximum(((argb >> shift) & 255) - delta, 1)
        return np.where(known, 0xFF000000 + (channel(16) << 16) + (channel(8) << 8) + channel(0), np.nan)

    return run, 0


def flooded(level: float | str) -> tuple[Step, int]:
    """Extent is the input layer, depth the other; the level a number, or a carried column of requests."""

    def run(t: Tiles) -> np.ndarray:
        extent, at = t.value, t.carried[level][:, None, None] if isinstance(level, str) else level
        return np.where((extent != 0) & (extent <= at) & (extent > -1), at - t.origin("depth"), np.nan)

    return run, 0


# --- products ----------------------------------------------------------------------------


def _hillshade(altitude: float, azimuth: float) -> list[tuple[Step, int]]:
    return [exaggerate("hillshade"), focal("hillshade", altitude=altitude, azimuth=azimuth), normalize(0, 127, 1, 254)]


def _color(colormap: str = Y.DEM_COLORMAP) -> Plan:
    return Plan([local(classes(colormap))])


def _grey(stops: int = 254) -> Plan:
    return Plan([ranks(stops), greys(stops)])


def _contour(integer_layer: bool = True) -> Plan:
    return Plan([contour(integer_layer), focal("flowdir")], T.DoubleType())


def _hillshade_plan(altitude: float = 60.0, azimuth: float = 315.0) -> Plan:
    return Plan([*_hillshade(altitude, azimuth), masked()])


def _aspect(colormap: str = Y.ASPECT_COLORMAP) -> Plan:
    return Plan([focal("aspect"), local(classes(colormap, at_least=True))])


def _slope() -> Plan:
    return Plan([exaggerate("slope"), focal("slope"), normalize(0, 100, 1, 254), masked()])


def _color_hillshade(altitude: float = 60.0, azimuth: float = 315.0, colormap: str = Y.DEM_COLORMAP) -> Plan:
    return Plan([*_hillshade(altitude, azimuth), shaded(colormap), masked()])


def _hand(level: float | str, colormap: str = Y.HAND_COLORMAP) -> Plan:
    return Plan([flooded(level), local(classes(colormap))], layers=("depth",))


PRODUCTS: dict[str, Callable[..., Plan]] = {
    "color": _color,
    "grey": _grey,
    "contour": _contour,
    "hillshade": _hillshade_plan,
    "aspect": _aspect,
    "slope": _slope,
    "color-hillshade": _color_hillshade,
    "hand": _hand,
}


def run_plan(plan: Plan, tiles: DataFrame, grid: Grid, carry: tuple[str, ...] = ()) -> DataFrame:
    """All steps of a plan over tiles ``(layer, zoom, col, row, data, *plan.layers, *carry)``."""
    width = plan.halo
    if width and plan.layers:
        raise ValueError("a product with a halo has one input layer")
    keys = (*KEYS, *carry)
    t = tiles.select(*keys, F.col("data").cast("array<double>").alias("data"), *(F.col(c).cast("array<double>").alias(c) for c in plan.layers))
    t = halo(t, grid, ("layer", "zoom", *carry), width=width).select(*keys, "data", *ROLES) if width else t
    schema = T.StructType([t.schema[c] for c in keys] + [T.StructField("data", T.ArrayType(plan.kind))])
    kind = pa.int64() if isinstance(plan.kind, T.LongType) else None
    shape = (grid.tile_rows, grid.tile_cols)
    steps, layers = plan.steps, plan.layers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore", RuntimeWarning)
        for rb in few_tiles(batches, grid):
            whole = padded(rb, grid, width)
            source = {"data": whole} | {name: padded(rb.select([name]).rename_columns(["data"]), grid, 0) for name in layers}
            carried = {name: np.array(rb.column(name).to_pylist()) for name in carry}
            state = Tiles(whole, width, source, width, np.array(rb.column("zoom").to_pylist()), carried)
            for step, used in steps:
                state.value = step(state)
                state.pad -= used
            assert state.value.shape[1:] == shape
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keys), list_column(state.value.reshape(len(whole), -1), kind)], [*keys, "data"])

    return t.mapInArrow(run, schema)


def product(name: str, tiles: DataFrame, grid: Grid, depth: DataFrame | None = None, carry: tuple[str, ...] = (), **params) -> DataFrame:
    """The named product of a layer: tiles ``(layer, zoom, col, row, *carry, data)``, colours and whole numbers as BIGINT,
    directions as DOUBLE, NULL for NODATA.

    ``tiles`` may hold several layers and zooms; parameters that hang on the zoom follow each tile's.  ``carry``: further columns
    that tell tiles apart (requests that ask for one tile several times).  ``hand`` takes the extent layer as ``tiles``, the
    ``depth`` layer beside it (tiles that either lacks give no row) and a ``level``, a number or a carried column.  Unknown names
    and parameters raise."""
    if name not in PRODUCTS:
        raise ValueError(f"no product {name}; there are {', '.join(PRODUCTS)}")
    plan = PRODUCTS[name](**params)
    if ("depth" in plan.layers) != (depth is not None):
        raise ValueError(f"{name} takes {'a' if 'depth' in plan.layers else 'no'} depth layer")
    if depth is not None:
        # one layer's tiles beside the other's, by key; the layers' own names differ
        tiles = tiles.join(depth.select("zoom", "col", "row", F.col("data").alias("depth")), ["zoom", "col", "row"])
    return run_plan(plan, tiles, grid, carry)
