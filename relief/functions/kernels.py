"""3x3 kernels (F1-F5), stated twice with identical arithmetic:

* as Spark Columns over the nine neighbourhood columns ``a b c / d e f / g h i``
  (``e`` = centre, north up) -- used by the cell path and readable as SQL;
* as NumPy over the nine shifted views of a padded tile -- used inside the
  Arrow-batched halo path, where one call handles a whole tile.

Any NULL in the window gives NULL, except for the median, which ignores NULLs.
Gradients after Horn (1981); flow direction after Jenson & Domingue (1988).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("a", "b", "c", "d", "e", "f", "g", "h", "i")
# (dx, dy) of each window position relative to the centre; dy grows south
OFFSETS = {
    "a": (-1, -1), "b": (0, -1), "c": (1, -1),
    "d": (-1, 0), "e": (0, 0), "f": (1, 0),
    "g": (-1, 1), "h": (0, 1), "i": (1, 1),
}
# D8 direction codes and the neighbour each points to.
D8 = (("f", 1, False), ("i", 2, True), ("h", 4, False), ("g", 8, True),
      ("d", 16, False), ("a", 32, True), ("b", 64, False), ("c", 128, True))
SQRT2 = math.sqrt(2.0)


# --- Column form ---------------------------------------------------------------

def _w(n: str) -> Column:
    return F.col(n)


def horn_pq(cell_size: float) -> tuple[Column, Column]:
    a, b, c, d, f, g, h, i = (_w(n) for n in "abcdfghi")
    k = F.lit(8.0 * cell_size)
    p = ((c + 2 * f + i) - (a + 2 * d + g)) / k
    q = ((g + 2 * h + i) - (a + 2 * b + c)) / k
    return p, q


def slope_col(cell_size: float = 3.0) -> Column:
    p, q = horn_pq(cell_size)
    return F.degrees(F.atan(F.sqrt(p * p + q * q)))


def aspect_col(cell_size: float = 3.0) -> Column:
    """Downslope bearing, degrees clockwise from north; flat -> -1."""
    p, q = horn_pq(cell_size)
    return F.when((p == 0) & (q == 0), F.lit(-1.0)).otherwise((F.degrees(F.atan2(-p, q)) + 360.0) % 360.0)


def hillshade_col(cell_size: float = 3.0, altitude: float = 60.0, azimuth: float = 315.0) -> Column:
    p, q = horn_pq(cell_size)
    zen = math.radians(90.0 - altitude)
    az = math.radians(azimuth)
    s = F.atan(F.sqrt(p * p + q * q))
    asp = F.atan2(-p, q)
    v = F.lit(math.cos(zen)) * F.cos(s) + F.lit(math.sin(zen)) * F.sin(s) * F.cos(F.lit(az) - asp)
    # greatest() skips NULLs, so keep a NULL window NULL explicitly
    return F.when(v.isNotNull(), F.lit(127.0) * F.greatest(F.lit(0.0), v))


def flow_direction_col() -> Column:
    e = _w("e")
    drops = [
        F.struct(((e - _w(n)) / F.lit(SQRT2) if diag else (e - _w(n))).alias("drop"), F.lit(-code).alias("nc"))
        for n, code, diag in D8
    ]
    best = F.array_max(F.array(*drops))
    any_null = F.lit(False)
    for n in NAMES:
        any_null = any_null | _w(n).isNull()
    return F.when(~any_null & (best["drop"] > 0), (-best["nc"]).cast("double"))


def median_col() -> Column:
    arr = F.array_sort(F.array_compact(F.array(*[_w(n) for n in NAMES])))
    n = F.size(arr)
    mid = F.try_element_at(arr, (n / 2 + 0.5).cast("int"))
    lo = F.try_element_at(arr, (n / 2).cast("int"))
    hi = F.try_element_at(arr, (n / 2 + 1).cast("int"))
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, mid).otherwise((lo + hi) / 2)


def _centre_valid(c: Column) -> Column:
    """Horn's gradient does not read the centre; a NODATA centre still gives NODATA."""
    return F.when(_w("e").isNotNull(), c)


def kernel_col(op: str, **kw) -> Column:
    if op == "slope":
        return _centre_valid(slope_col(kw.get("cell_size", 3.0)))
    if op == "aspect":
        return _centre_valid(aspect_col(kw.get("cell_size", 3.0)))
    if op == "hillshade":
        return _centre_valid(hillshade_col(kw.get("cell_size", 3.0), kw.get("altitude", 60.0), kw.get("azimuth", 315.0)))
    if op == "flowdir":
        return flow_direction_col()
    if op == "median":
        return median_col()
    raise ValueError(op)


# --- NumPy form (one padded tile at a time) ----------------------------------

def windows(padded: np.ndarray) -> dict[str, np.ndarray]:
    """Nine shifted views of padded tiles ``(..., rows+2, cols+2)`` (a batch works too)."""
    r, c = padded.shape[-2:]
    out = {}
    for n, (dx, dy) in OFFSETS.items():
        out[n] = padded[..., 1 + dy : r - 1 + dy, 1 + dx : c - 1 + dx]
    return out


def _np_pq(w, cell_size):
    k = 8.0 * cell_size
    p = ((w["c"] + 2 * w["f"] + w["i"]) - (w["a"] + 2 * w["d"] + w["g"])) / k
    q = ((w["g"] + 2 * w["h"] + w["i"]) - (w["a"] + 2 * w["b"] + w["c"])) / k
    return p, q


def _gradient_np(op: str, w: dict, cs: float, kw: dict) -> np.ndarray:
    p, q = _np_pq(w, cs)
    if op == "slope":
        return np.degrees(np.arctan(np.sqrt(p * p + q * q)))
    if op == "aspect":
        a = np.mod(np.degrees(np.arctan2(-p, q)) + 360.0, 360.0)
        return np.where((p == 0) & (q == 0), -1.0, a)
    zen = math.radians(90.0 - kw.get("altitude", 60.0))
    az = math.radians(kw.get("azimuth", 315.0))
    s = np.arctan(np.sqrt(p * p + q * q))
    v = math.cos(zen) * np.cos(s) + math.sin(zen) * np.sin(s) * np.cos(az - np.arctan2(-p, q))
    return np.where(np.isnan(v), np.nan, 127.0 * np.maximum(0.0, v))


def kernel_np(op: str, padded: np.ndarray, **kw) -> np.ndarray:
    if kw.get("zfactor") is not None:
        padded = padded * kw["zfactor"]
    w = windows(padded)
    cs = kw.get("cell_size", 3.0)
    if op in ("slope", "aspect", "hillshade"):
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.isnan(w["e"]), np.nan, _gradient_np(op, w, cs, kw))
    with np.errstate(invalid="ignore", divide="ignore"):
        if op == "flowdir":
            e = w["e"]
            drops = np.stack([(e - w[n]) / SQRT2 if diag else (e - w[n]) for n, _, diag in D8])
            any_nan = np.isnan(np.stack([w[n] for n in NAMES])).any(axis=0)
            best = np.argmax(np.where(np.isnan(drops), -np.inf, drops), axis=0)  # first max = smallest code
            codes = np.array([code for _, code, _ in D8], dtype=float)[best]
            top = np.take_along_axis(drops, best[None], axis=0)[0]
            return np.where(any_nan | ~(top > 0), np.nan, codes)
        if op == "median":
            stack = np.sort(np.stack([w[n] for n in NAMES]), axis=0)  # NaN sorts last
            n = (~np.isnan(stack)).sum(axis=0)
            lo = np.take_along_axis(stack, np.maximum((n - 1) // 2, 0)[None], axis=0)[0]
            hi = np.take_along_axis(stack, np.maximum(n // 2, 0)[None], axis=0)[0]
            return np.where(n == 0, np.nan, np.where(n % 2 == 1, hi, (lo + hi) / 2))
    raise ValueError(op)
