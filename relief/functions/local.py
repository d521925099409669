"""Cell-wise map-algebra expressions (L3-L7, L9).  Column -> Column, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vertical exaggeration fitted per zoom level, z * a * zoom^b.
HILLSHADE_EXAGGERATION = (7.440927e-7, 5.678745)
SLOPE_EXAGGERATION = (1.746438e-5, 4.826353)

# Contour interval (elevation units) per zoom level.
CONTOUR_INTERVAL = {17: 1, 16: 2, 15: 4, 14: 5, 13: 10}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exaggeration_factor(zoom: int, kind: str = "hillshade") -> float:
    """L3 factor ``a * zoom^b`` for one zoom level (a constant per request)."""
    a, b = HILLSHADE_EXAGGERATION if kind == "hillshade" else SLOPE_EXAGGERATION
    return a * float(zoom) ** b


def exaggerate(v: Column | str, zoom: int | Column, kind: str = "hillshade") -> Column:
    """L3: z * a * zoom^b (zoom may be a column when requests mix levels)."""
    if isinstance(zoom, int):
        return _c(v) * F.lit(exaggeration_factor(zoom, kind))
    a, b = HILLSHADE_EXAGGERATION if kind == "hillshade" else SLOPE_EXAGGERATION
    return _c(v) * F.lit(a) * F.pow(zoom.cast("double"), F.lit(b))


def contour_quantise(v: Column | str, zoom: int | Column, integer_layer: bool = False) -> Column:
    """L4: z / interval(zoom); an unknown zoom gives NULL.  Integer layers truncate towards zero."""
    m = F.create_map(*[x for k, d in sorted(CONTOUR_INTERVAL.items()) for x in (F.lit(k), F.lit(d))])
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    q = _c(v) / F.try_element_at(m, z)
    return q.cast("bigint").cast("double") if integer_layer else q


def normalize(v: Column | str, old_min: float, old_max: float, new_min: float, new_max: float, to_int: bool = True) -> Column:
    """Linear [old_min, old_max] -> [new_min, new_max]; truncated to INT like an integer tile."""
    r = (_c(v) - F.lit(old_min)) * F.lit(new_max - new_min) / F.lit(old_max - old_min) + F.lit(new_min)
    return r.cast("int") if to_int else r


def mask_nodata(v: Column | str, mask: Column | str, fill=0) -> Column:
    """Where the mask raster is NODATA the result is ``fill``, else the value."""
    return F.when(_c(mask).isNull(), F.lit(fill)).otherwise(_c(v))


def zero_to_nodata(v: Column | str) -> Column:
    """0 -> NODATA."""
    return F.nullif(_c(v), F.lit(0).cast("double"))


def flood_depth(depth: Column | str, ext: Column | str, level: Column | float) -> Column:
    """ext == 0 -> NODATA; -1 < ext <= level -> level - depth; otherwise NODATA."""
    ext = _c(ext)
    level = level if isinstance(level, Column) else F.lit(float(level))
    return F.when(ext == 0, F.lit(None).cast("double")).when((ext <= level) & (ext > -1), level - _c(depth))
