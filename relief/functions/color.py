"""Symbology: value -> colour integer (Y1-Y4), colour-map definitions.

Two packings are kept apart, as in the reference:
* ramp colours are RGBA ``0xRRGGBBAA``;
* colour-map colours are the definition's raw hex, read as ``0xAARRGGBB``.
Colours are unsigned BIGINT (no 32-bit wrap).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Colour-map definitions used by the products.  The reference loads
# its maps from a configuration file that is not published; these are ours.
DEM_COLORMAP = "0:ff0000ff;50:ff00a0ff;100:ff40c040;200:ffa0d000;300:ffe0a000;400:ffc06000;500:ffffffff"
ASPECT_COLORMAP = "-1:ff808080;0:ffff0000;45:ffffa500;90:ffffff00;135:ff00ff00;180:ff00ffff;225:ff0000ff;270:ff8000ff;315:ffff00ff"
HAND_COLORMAP = "0:ffc0e0ff;1:ff80c0ff;2:ff4090ff;5:ff0060ff;10:ff0030c0;20:ff001080"


def parse_colormap(definition: Column | str) -> Column:
    """``"limit:HEX;limit:HEX"`` -> sorted ARRAY<STRUCT<limit DOUBLE, color BIGINT>>.

    Spaces around ``;`` are trimmed; a malformed definition gives NULL."""
    d = F.col(definition) if isinstance(definition, str) else definition
    parts = F.transform(F.split(d, ";"), lambda p: F.split(F.trim(p), ":"))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.get(p, 0).try_cast("double").alias("limit"),
            F.when(F.get(p, 1).rlike("^[0-9a-fA-F]{1,8}$"), F.conv(F.get(p, 1), 16, 10).cast("bigint")).alias("color"),
        ),
    )
    ok = F.forall(parts, lambda p: F.size(p) == 2) & F.forall(
        entries, lambda e: e["limit"].isNotNull() & e["color"].isNotNull()
    )
    return F.when(F.coalesce(ok, F.lit(False)), F.array_sort(entries))


@lru_cache(maxsize=64)
def color_entries(definition: str) -> tuple[tuple[float, int], ...] | None:
    """S10 of a constant definition, as values on the driver: sorted (limit, colour), None if it is malformed."""
    row = SparkSession.active().range(1).select(parse_colormap(F.lit(definition)).alias("m")).first()
    return None if row.m is None else tuple((e["limit"], e["color"]) for e in row.m)


def classify_le(v: Column | str, cmap: Column | str) -> Column:
    """Colour of the first class with ``v <= limit``; above the last limit -> last
    colour; NODATA -> 0.

    ``cmap`` is a colour-map column (S10, e.g. joined from a definitions table) or a
    constant definition string, which becomes a CASE chain inside whole-stage codegen."""
    v = F.col(v) if isinstance(v, str) else v
    if isinstance(cmap, str):
        cm = color_entries(cmap)
        if cm is None:
            return F.lit(None).cast("bigint")
        e = F.when(v.isNull(), F.lit(0).cast("bigint"))
        for lim, colour in cm:
            e = e.when(v <= F.lit(lim), F.lit(colour).cast("bigint"))
        return e.otherwise(F.lit(cm[-1][1]).cast("bigint"))
    hit = F.try_element_at(F.filter(cmap, lambda e: v <= e["limit"]), F.lit(1))
    return F.when(v.isNull(), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(hit["color"], F.try_element_at(cmap, F.lit(-1))["color"])
    )


def classify_ge(v: Column | str, cmap: Column | str) -> Column:
    """Y2: colour of the last class with ``v >= limit``; below the first limit -> first
    colour; NODATA -> 0.  ``cmap`` as for :func:`classify_le`."""
    v = F.col(v) if isinstance(v, str) else v
    if isinstance(cmap, str):
        cm = color_entries(cmap)
        if cm is None:
            return F.lit(None).cast("bigint")
        e = F.when(v.isNull(), F.lit(0).cast("bigint"))
        for lim, colour in reversed(cm):
            e = e.when(v >= F.lit(lim), F.lit(colour).cast("bigint"))
        return e.otherwise(F.lit(cm[0][1]).cast("bigint"))
    hit = F.try_element_at(F.filter(cmap, lambda e: v >= e["limit"]), F.lit(-1))
    return F.when(v.isNull(), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(hit["color"], F.try_element_at(cmap, F.lit(1))["color"])
    )


def grey_level(i: Column, stops: int) -> Column:
    """Grey of ramp stop ``i`` of ``0..stops``: ``floor(i / stops * 255 + 0.5)`` exactly."""
    return F.floor((i.cast("bigint") * 510 + stops) / F.lit(2 * stops)).cast("bigint")


def grey_rgba(i: Column, stops: int) -> Column:
    """RGBA colour ``0xGGGGGGFF`` of ramp stop ``i``."""
    g = grey_level(i, stops)
    return g * 16777216 + g * 65536 + g * 256 + 255


def shade_blend(argb: Column, shade: Column) -> Column:
    """Darken a colour-map colour (``0xAARRGGBB``) by a 0..255 shade:
    each channel ``max(ch - (255 - shade), 1)``, alpha 255; result ``0xFFRRGGBB``."""
    delta = F.lit(255) - shade.cast("bigint")

    def ch(shift: int) -> Column:
        return F.greatest(F.shiftright(argb, shift).bitwiseAND(F.lit(255)) - delta, F.lit(1))

    blended = F.lit(0xFF000000) + F.shiftleft(ch(16), 16) + F.shiftleft(ch(8), 8) + ch(0)
    return F.when(shade.isNotNull(), blended)


def classify_requests(values: DataFrame, maps: DataFrame, at_least: bool = False) -> DataFrame:
    """Y1 / Y2 with a colour map per request: ``values (id, name, value)`` and ``maps (name, definition)`` give ``(id, name,
    value, color)``.

    Definitions are parsed once per map, then looked up by name; a request whose map is unknown or malformed keeps its row
    with a NULL colour.  A value finds its class in the map's sorted array (an as-of lookup)."""
    parsed = maps.select("name", parse_colormap("definition").alias("_map"))
    classify = classify_ge if at_least else classify_le
    found = values.join(parsed, "name", "left")
    return found.select("id", "name", "value", F.when(F.col("_map").isNotNull(), classify("value", F.col("_map"))).alias("color"))


def colormap_literal(definition: str) -> Column:
    """A definition string as a constant column (folded by Catalyst)."""
    return parse_colormap(F.lit(definition))
