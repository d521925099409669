"""Registry of the queries the driver runs: name -> (spark, sf_dir) -> DataFrame,
and name -> DuckDB oracle SQL.  Keys carry the SURVEY section-2 row id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relief.operators.rasterize import rasterize
from relief.plans import oracle as O
from relief.plans import products as P
from relief.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def _g9_rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = rasterize(fx.flood_polygons(spark, sf_dir), fx.FIXTURE_GRID)
    return cover.groupBy("id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("gx").alias("sum_gx"),
        F.sum("gy").alias("sum_gy"),
        F.min("gx").alias("min_gx"),
        F.max("gx").alias("max_gx"),
        F.min("gy").alias("min_gy"),
        F.max("gy").alias("max_gy"),
    )


QUERIES: dict[str, Query] = {
    "p10_flood_summary": P.flood_summary,
    "k2_flood_classes": P.flood_class_shares,
    "g9_rasterize": _g9_rasterize,
    "k4_point_value": P.point_value,
    "f1_slope": lambda s, d: P.focal_layer(s, d, "slope"),
    "f2_aspect": lambda s, d: P.focal_layer(s, d, "aspect"),
    "f3_hillshade": lambda s, d: P.focal_layer(s, d, "hillshade"),
    "f4_flow_direction": lambda s, d: P.focal_layer(s, d, "flowdir"),
    "f5_focal_median": lambda s, d: P.focal_layer(s, d, "median"),
    "p1_color": lambda s, d: P.rendered(s, d, "color"),
    "p2_grey": lambda s, d: P.rendered(s, d, "grey"),
    "p3_contour": lambda s, d: P.rendered(s, d, "contour", "value", "double"),
    "p4_hillshade": lambda s, d: P.rendered(s, d, "hillshade", "value", "int"),
    "p5_aspect": lambda s, d: P.rendered(s, d, "aspect"),
    "p6_slope": lambda s, d: P.rendered(s, d, "slope", "value", "int"),
    "p7_color_hillshade": lambda s, d: P.rendered(s, d, "color-hillshade"),
    "p8_hand": P.hand,
    "v2_viewshed_r2": P.viewshed_r2,
    "v3_viewshed_exact": P.viewshed_exact,
    "v4_viewshed_approx": P.viewshed_approx,
    "p11_viewshed_mask": P.viewshed_mask,
    "z1_regions": P.regions,
    "z3_region_polygons": P.region_polygons,
    "p12_viewshed_polygons": P.viewshed_polygons,
    "s1_stored_product": P.stored_product,
    "s2_tile_lookup": P.tile_lookup,
    "s3_layer_metadata": P.layer_metadata,
    "s4_key_bounds": P.key_bounds_guard,
    "s5_point_requests": P.point_request_check,
    "s7_collection_polygon": P.collection_polygon,
    "s8_array_raster": P.array_raster,
    "s9_pack": P.pack_stats,
    "s10_colormaps": P.colormap_requests,
    "s11_json_sink": P.json_sink,
    "s12_request_stream": P.request_stream,
    "g1_reproject": P.reproject,
    "g5_point_tiles": P.point_tile_value,
    "g6_polygon_tiles": P.polygon_tiles,
    "g7_buffer_tiles": P.buffer_tiles,
    "l2_combine": P.combine,
    "l2_combine_tiles": P.combine_packed,
    "v1_observers": P.observers,
    "p13_fixed_cell_viewshed": P.fixed_cell_viewshed,
    "p13_fixed_cell_approx": P.fixed_cell_approx,
    "m1_stitch": P.stitched,
    "l3_exaggerate": P.exaggerated,
    "l4_contour_quantise": P.contour_levels,
    "l5_normalize": P.normalized,
    "l6_mask_nodata": P.masked,
    "l7_zero_to_nodata": P.zero_as_nodata,
    "l8_override": P.overridden,
    "l9_flood_depth": P.flood_depth,
    "m3_crop": P.cropped,
    "k5_quantile_class": P.quantile_classes,
    "f0_neighbourhood": P.neighbourhoods,
}

ORACLE: dict[str, str] = {
    "p10_flood_summary": O.P10_FLOOD_SUMMARY,
    "k2_flood_classes": O.K2_FLOOD_CLASSES,
    "g9_rasterize": O.G9_RASTERIZE,
    "k4_point_value": O.K4_POINT_VALUE,
    "f1_slope": O.focal_sql("slope"),
    "f2_aspect": O.focal_sql("aspect"),
    "f3_hillshade": O.focal_sql("hillshade"),
    "f4_flow_direction": O.focal_sql("flowdir"),
    "f5_focal_median": O.focal_sql("median"),
    "p1_color": O.P1_COLOR,
    "p2_grey": O.P2_GREY,
    "p3_contour": O.P3_CONTOUR,
    "p4_hillshade": O.P4_HILLSHADE,
    "p5_aspect": O.P5_ASPECT,
    "p6_slope": O.P6_SLOPE,
    "p7_color_hillshade": O.P7_COLOR_HILLSHADE,
    "p8_hand": O.P8_HAND,
    "v2_viewshed_r2": O.V2_VIEWSHED,
    "v3_viewshed_exact": O.V3_VIEWSHED_EXACT,
    "v4_viewshed_approx": O.V4_VIEWSHED_APPROX,
    "p11_viewshed_mask": O.P11_VIEWSHED_MASK,
    "z1_regions": O.Z1_REGIONS,
    "z3_region_polygons": O.Z3_REGION_POLYGONS,
    "p12_viewshed_polygons": O.P12_VIEWSHED_POLYGONS,
    "s1_stored_product": O.P7_COLOR_HILLSHADE,
    "s2_tile_lookup": O.S2_TILE_LOOKUP,
    "s3_layer_metadata": O.S3_LAYER_METADATA,
    "s4_key_bounds": O.S4_KEY_BOUNDS,
    "s5_point_requests": O.S5_POINT_REQUESTS,
    "s7_collection_polygon": O.S7_COLLECTION_POLYGON,
    "s8_array_raster": O.S8_ARRAY_RASTER,
    "s9_pack": O.S9_PACK,
    "s10_colormaps": O.S10_COLORMAPS,
    "s11_json_sink": O.P10_FLOOD_SUMMARY,
    "s12_request_stream": O.S12_REQUEST_STREAM,
    "g1_reproject": O.G1_REPROJECT,
    "g5_point_tiles": O.K4_POINT_VALUE,
    "g6_polygon_tiles": O.G6_POLYGON_TILES,
    "g7_buffer_tiles": O.G7_BUFFER_TILES,
    "l2_combine": O.L2_COMBINE,
    "l2_combine_tiles": O.L2_COMBINE_TILES,
    "v1_observers": O.V1_OBSERVERS,
    "p13_fixed_cell_viewshed": O.P13_FIXED_CELL_VIEWSHED,
    "p13_fixed_cell_approx": O.P13_FIXED_CELL_APPROX,
    "m1_stitch": O.M1_STITCH,
    "l3_exaggerate": O.L3_EXAGGERATE,
    "l4_contour_quantise": O.L4_CONTOUR,
    "l5_normalize": O.L5_NORMALIZE,
    "l6_mask_nodata": O.L6_MASK,
    "l7_zero_to_nodata": O.L7_ZERO_NODATA,
    "l8_override": O.L8_OVERRIDE,
    "l9_flood_depth": O.L9_FLOOD_DEPTH,
    "m3_crop": O.M3_CROP,
    "k5_quantile_class": O.K5_QUANTILE_CLASS,
    "f0_neighbourhood": O.F0_NEIGHBOURHOOD,
}
