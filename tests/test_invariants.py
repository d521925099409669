"""Invariants across operators."""

import random

from pyspark.sql import functions as F

from relief.operators import vectorize as Z
from relief.operators.rasterize import rasterize
from relief.plans import catalog
from relief.schema import Grid

G = Grid(xmin=0.0, ymax=0.0, cell_w=1.0, cell_h=1.0, tile_cols=4, tile_rows=4)


def test_rasterize_of_vectorize_is_identity(spark, raster):
    rnd = random.Random(3)
    rows = [[float(rnd.randint(0, 2)) if rnd.random() > 0.1 else None for _ in range(14)] for _ in range(11)]
    lab = Z.regions(raster(rows), segment=5)
    rings = Z.region_rings(lab)
    # grid-corner rings -> map coordinates of the unit grid (y = -gy), then back to cells
    poly = rings.groupBy("region").agg(
        F.array_sort(F.collect_list(F.struct("ring", F.arrays_zip("xs", "ys").alias("p")))).alias("rs")
    ).select(
        F.col("region").alias("id"),
        F.transform("rs", lambda r: F.transform(r["p"], lambda q: F.struct(q["xs"].cast("double").alias("x"), (-q["ys"]).cast("double").alias("y")))).alias("rings"),
    )
    back = rasterize(poly, G).select(F.col("id").alias("region"), "gx", "gy")
    exp = lab.select("region", "gx", "gy")
    assert back.exceptAll(exp).count() == 0 and exp.exceptAll(back).count() == 0


def test_interval_counts_sum_to_total(spark):
    sf = "/root/testdata/sf0.01"
    classes = catalog.QUERIES["k2_flood_classes"](spark, sf).groupBy("id").agg(F.sum("cells").alias("s"))
    summary = catalog.QUERIES["p10_flood_summary"](spark, sf)
    j = summary.join(classes, "id", "left").select("total", F.coalesce("s", F.lit(0)).alias("s"))
    assert j.where("total != s").count() == 0
