"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relief.llm.common import drop_table, shared_table


EDGES_PER_PARTITION = 100_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """``edges`` with m, the least v of their u.  Few edges are in one partition, where a window needs no shuffle; others are
    joined, as Spark then splits what is shuffled for a u of many edges."""
    if few:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``u, v`` of every row: one row per pair of its columns."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every greater neighbour of u, moved to the least of u and its neighbours."""
    both = _with_least(_each(edges, ("u", "v"), ("v", "u")), few)
    return both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """u and its lesser neighbours, moved to the least of them."""
    return _each(_with_least(edges, few), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def _round(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges after a large-star and a small-star step.  They are read in as few partitions as they need; a round
    over one of these is one task without any shuffle, so that few edges don't cost the driver hundreds of tasks a round."""
    few = n <= EDGES_PER_PARTITION
    return _small_star(_large_star(edges.coalesce(ceil(n / EDGES_PER_PARTITION)), few), few)


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links`` (a, b long) to ``node, component``: the least node reachable, for every node that has a link.

    Null ends and links of a node to itself are ignored.  Each round writes its edges to the shared folder; the rounds
    end when one leaves the edges as they were (number and sum of hashes), which then are stars around the least nodes.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = shared_table(links.where("a is not null and b is not null and a <> b").select(a.alias("u"), b.alias("v")).distinct())
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, edges = edges, shared_table(_round(edges, before[0]))
        drop_table(last)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links had not settled after {max_rounds} rounds")
    stars = _each(edges.coalesce(max(1, ceil(before[0] / EDGES_PER_PARTITION))), ("u", "v"), ("v", "v")).distinct()
    labels = shared_table(stars.select(F.col("u").alias("node"), F.col("v").alias("component")))
    drop_table(edges)
    return labels
