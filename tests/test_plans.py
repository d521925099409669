"""Physical-plan shape: pruning, shuffle count, join strategy."""

import os

import pytest

from relief.plans import catalog
from relief.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = plan_of(fx.dem(spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in p


def test_focal_is_two_shuffles(spark):
    # one to pack cells into tiles, one halo exchange; the kernel runs in Arrow batches
    p = plan_of(catalog.QUERIES["f1_slope"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 2
    assert "MapInArrow" in p and "SortAggregate" not in p


def test_flood_join_has_no_side_of_cells(spark):
    """Spans meet packed tiles; a tile's cells are counted above the join, without a shuffle of cells."""
    p = plan_of(catalog.QUERIES["k2_flood_classes"](spark, SF))
    counted, joined = p.index("explode(slice(data"), p.index("Join [col")
    assert counted < joined  # the plan is printed from the top
    assert "gx_lo" not in p and "explode(sequence" not in p
    assert "BroadcastHashJoin" in p  # few spans: Catalyst knows their size
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = plan_of(catalog.QUERIES["k2_flood_classes"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in q and "LeftSemi" in q and "BroadcastHashJoin" not in q


def test_products_shuffle_once_for_a_halo_and_never_without(spark, tmp_path):
    from relief.plans import products as P
    from relief.plans.compose import PRODUCTS, product
    from relief.sources import layers as S

    path = P.stored_dem(spark, SF)
    t = S.read_layer(spark, path, "dem", P.ZOOM)
    for name in set(PRODUCTS) - {"hand"}:
        p = plan_of(product(name, t, P.G))
        assert p.count("Exchange hashpartitioning") == (0 if name in ("color", "grey") else 1) and p.count("MapInArrow") == 1, name
        assert "PartitionFilters" in p and "ReadSchema: struct<col:int,row:int,data:array<double>>" in p
