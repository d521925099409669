"""Exact deduplication by progressive refinement, in built-in DataFrame functions only.

Rows are grouped by length, the rows of shared lengths by a hash of their first characters, and only the rows whose
(length, prefix hash) is shared too have their whole text hashed.  Between two steps travels the set of *cells*
(hashes of the surviving keys modulo ``cells``) as a bitmap of at most 32 MB, so it is broadcast and no text is ever
shuffled.  A cell hit by chance only lets a row through to the next, exact, step.  Groups that hold more than
1/4096 of all rows (at most 4096 of them) are broadcast to their rows; only the rows of the others meet their group
by a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_CELLS = 1 << 28
HOT_SHARE = 4096


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    folded = F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(folded)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    cells: int | None = None,
    hash_all: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``content_hash``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id is kept.
    ``content_hash`` (SHA-256 of the normalised text) is null for rows that dropped out before the full hash, unless
    ``hash_all`` asks for every row's.

    Null text: equal to the empty text.  Null id: smaller than any id; a group of null ids only keeps all its rows.
    Repeated rows (same id and text) share one fate, so both are kept or both dropped.  Other columns are ignored.
    An empty table gives an empty result.  ``cells``: a multiple of 32,768; by default 16 per row, from 2**18 up to 2**28.
    """
    total = docs.count()
    if cells is None:
        cells = min(MOST_CELLS, max(1 << 18, 1 << (16 * total).bit_length()))
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn(
        "_len", F.octet_length("_t")
    )

    def cell(*key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(cells))

    def shared(rows: DataFrame, *key: str) -> DataFrame:
        """Bitmaps of the cells of the keys that more than one row has, 32,768 cells each."""
        groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        held = groups.select(cell(*key).alias("_cell")).groupBy(F.expr("_cell div 32768").alias("_page"))
        return F.broadcast(held.agg(F.bitmap_construct_agg(F.col("_cell") % 32768).alias("_bits")))

    def marked(rows: DataFrame, pages: DataFrame, *key: str) -> DataFrame:
        """``rows`` with ``_hit``: is their key's cell in the bitmaps."""
        place = rows.withColumn("_cell", cell(*key)).withColumn("_page", F.expr("_cell div 32768")).join(pages, "_page", "left")
        byte = F.conv(F.hex(F.expr("substring(_bits, cast(_cell % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
        bit = F.expr("shiftleft(1, cast(_cell % 8 as int))")
        return place.withColumn("_hit", F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False))).drop("_cell", "_page", "_bits")

    prefix = F.xxhash64(lower_ascii(F.substring("_t", 1, prefix_chars)))
    same_length = marked(base, shared(base, "_len"), "_len").where("_hit").drop("_hit").withColumn("_prefix", prefix)
    prefixes = shared(same_length, "_len", "_prefix")
    survivors = marked(same_length, prefixes, "_len", "_prefix").where("_hit")
    digest = F.sha2(lower_ascii(F.col("_t")), 256)
    groups = (
        survivors.select("_id", digest.alias("_h"))
        .groupBy("_h")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .withColumnRenamed("_h", "_g")
    )
    large = F.col("_n") * HOT_SHARE > total
    hot = groups.where(large).select(F.col("_g").alias("_h"), F.col("_keep").alias("_hot_keep"), F.col("_n").alias("_hot_n"))
    whole = digest if hash_all else F.when(F.col("_hit"), digest)
    rows = marked(base.withColumn("_prefix", prefix), prefixes, "_len", "_prefix").select("_id", whole.alias("_h")).join(F.broadcast(hot), "_h", "left")
    # rows without a hash, and those that have met their group, get keys of their own: they neither match nor meet
    own = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_g", F.when(F.col("_hot_n").isNull(), F.coalesce("_h", own)).otherwise(own))
    joined = rows.join(groups.where(~large), "_g", "left").withColumns({"_keep": F.coalesce("_hot_keep", "_keep"), "_n": F.coalesce("_hot_n", "_n")})
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_h").alias("content_hash"),
    )
