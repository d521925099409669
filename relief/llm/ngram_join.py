"""N-gram Jaccard join: documents whose sets of word shingles are similar, with their connected components.

1. Every text becomes its set of hashed shingles.  Equal sets form a class; from here only one member of a class goes on.
2. Shingles are ordered by (level, hash); ``level`` rises with the frequency class, from a count sketch of all shingles
   whose size does not depend on the input, so very common shingles come last.  Two sets that are similar enough share a
   shingle among the first ``size - least overlap + 1`` of both (prefix filter), so only sets that share such a shingle
   are brought together.
3. In each such group the sets' signature trees are traversed against themselves (``signature_tree``).  Groups of more than
   ``block`` sets are dealt to block pairs; small groups share a task, bounded in rows.
4. Surviving pairs are checked on the exact sets, recomputed from the whole texts of the documents concerned.

Steps 3 and 4 run twice or more.  The merging rounds (two by default) look at the first few shingles of a set that others
share, and of a set's surviving partners in other components take the one of greatest possible similarity (a Boruvka
step).  The first leaves a large group of near copies as a number of clusters, the second joins most of these into one
component, so that few pairs between clusters are left.  The last round takes every surviving pair between different components, so no link that
changes a component is lost, while copies of copies are not expanded into all pairs.

5. All links lie within components.  The exact sets of each component of several classes are brought together once more,
   a large component as pairs of blocks; the signature trees are traversed without the component test, every surviving
   pair is checked, and the tasks count the links of each class.  The links themselves are written out only on demand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relief.llm.common import binary_column, bounded_slices, drop_table, mix64, shared_table
from relief.llm.components import components
from relief.llm.shingles import shingle_sets
from relief.llm.signature_tree import CHUNK, LEAF, join_group, join_leaves, signature

SKETCH_CELLS = 1 << 20
SKETCH_CHUNK = 1 << 15
#: texts that a task works on at once; the arrays over their bytes take about 60 times as much
SLICE_BYTES = 1 << 18
HOT_SHARE = 4096
#: what tells the set of a document
OF_SET = ["doc", "size", "d1", "d2"]
#: shingles of a block of a component, and about those of the small components that share a task
BLOCK_SHINGLES, TASK_SHINGLES = 1 << 20, 1 << 18


def prefix_length(size: int, percent: int) -> int:
    """First shingles of a set, one of which any similar set shares: size - ceil(percent / 100 * size) + 1."""
    return size - -(-percent * size // 100) + 1


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """Per document its tag, size and a 128-bit digest of its set; per task the counts of all its shingles by hash cell, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, any_rows = np.zeros(SKETCH_CELLS, np.int64), False
        for batch in batches:
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                any_rows = True
                hashes, at = shingle_sets(part.column("_text"), words)
                np.add.at(cells, (hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), 1)
                none = pa.nulls(part.num_rows, pa.int32())
                described = [part.column("_id"), part.column("_tag"), pa.array(np.diff(at), pa.int64()), *map(pa.array, _digests(hashes, at))]
                yield pa.RecordBatch.from_arrays([*described, none, none, pa.nulls(part.num_rows, pa.binary())], names)
        if any_rows:
            chunks = cells.astype(np.uint32).reshape(-1, SKETCH_CHUNK)
            none = pa.nulls(len(chunks), pa.int64())
            # partial sums first meet in 256 groups of tasks, then in one per chunk
            salt = np.full(len(chunks), TaskContext.get().partitionId() % 256, np.int32)
            counts = [pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array(salt), binary_column([c.tobytes() for c in chunks])]
            yield pa.RecordBatch.from_arrays([none] * 5 + counts, names)

    names = ["doc", "tag", "size", "d1", "d2", "chunk", "salt", "counts"]
    return docs.mapInArrow(run, "doc long, tag long, size long, d1 long, d2 long, chunk int, salt int, counts binary")


def _digests(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.r_[np.uint64(0), np.cumsum(mix64(hashes ^ np.uint64(salt)))]
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out


def _levels(parts: DataFrame) -> np.ndarray:
    """Frequency level of each hash cell: 0 up to twice the mean load, one more per doubling (uint8, SKETCH_CELLS)."""

    def add(kind):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, kind).astype(np.uint64) for x in table.column("counts").to_pylist())
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": binary_column([total.tobytes()])})

        return run

    parts = parts.groupBy("chunk", "salt").applyInArrow(add(np.uint32), "chunk int, counts binary")
    parts = parts.groupBy("chunk").applyInArrow(add(np.uint64), "chunk int, counts binary")
    counts = np.zeros((SKETCH_CELLS // SKETCH_CHUNK, SKETCH_CHUNK), np.uint64)
    for row in parts.collect():  # SKETCH_CELLS counts, whatever the input
        counts[row.chunk] = np.frombuffer(row.counts, np.uint64)
    counts = counts.ravel().astype(np.float64)
    usual = 2 * max(1.0, counts.mean())
    return np.floor(np.log2(np.maximum(1, counts / usual))).astype(np.uint8)


def _describe(docs: DataFrame, words: int, percent: int, levels) -> DataFrame:
    """Per document with shingles: size, digest, its prefix shingles in order, its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                hashes, at = shingle_sets(part.column("_text"), words)
                rank = level[(hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)]
                prefix, marks = [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = hashes[lo:hi]
                    need = prefix_length(hi - lo, percent) if hi > lo else 0
                    order = np.argsort(rank[lo:hi], kind="stable")[:need]  # the hashes are ascending already
                    prefix.append(own[order].view(np.int64))
                    marks.append(signature(own))
                ends = np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32)
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))
                columns = [part.column("_id"), part.column("_tag"), pa.array(np.diff(at), pa.int64()), *map(pa.array, _digests(hashes, at)), listed, binary_column(marks)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "tag", "size", "d1", "d2", "prefix", "mark"])

    return docs.mapInArrow(run, "doc long, tag long, size long, d1 long, d2 long, prefix array<long>, mark binary").where("size > 0")


def _id_filter(ids: DataFrame, most_bits: int = 1 << 30):
    """(bits, broadcast bitmap): 16 to 32 bits per id up to ``most_bits`` (128 MB), bit ``hash(id) mod bits`` set for each.

    Lets a scan drop most documents that aren't wanted before they are shuffled; an exact join follows.
    """
    bits = min(most_bits, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    page = min(bits, 1 << 18)

    def fill(table: pa.Table) -> pa.Table:
        held = np.zeros(page, np.uint8)
        held[table.column("at").to_numpy()] = 1
        return pa.table({"page": table.column("page").slice(0, 1), "held": binary_column([np.packbits(held, bitorder="little").tobytes()])})

    cell = F.pmod(F.xxhash64("_id"), F.lit(bits))
    cells = ids.select((cell / page).cast("long").alias("page"), (cell % page).cast("int").alias("at")).distinct()
    bitmap = np.zeros((bits // page, page // 8), np.uint8)
    for row in cells.groupBy("page").applyInArrow(fill, "page long, held binary").collect():
        bitmap[row.page] = np.frombuffer(row.held, np.uint8)
    return bits, ids.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _candidates(members: DataFrame, percent: int, block: int, one_partner: bool) -> DataFrame:
    """Pairs (a < b) that survive the traversal, from ``members``: token, n (sets of the token), bin (tokens to
    be dealt together), node, size, component, mark."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token = table.column("token").to_numpy()
        side = table.column("side").to_numpy()
        node = table.column("node").to_numpy()
        size = table.column("size").to_numpy()
        component = table.column("component").to_numpy()
        mark = table.column("mark").to_pylist()
        order = np.lexsort((node, size, token))
        token, side, node, size = token[order], side[order], node[order], size[order]
        component = np.unique(component[order], return_inverse=True)[1]
        mark = [mark[k] for k in order.tolist()]
        starts = np.r_[0, np.flatnonzero(np.diff(token)) + 1]
        counts = np.diff(np.r_[starts, len(token)])
        small = (counts > 1) & (counts <= LEAF) if not side.any() else np.zeros(len(counts), bool)

        def survivors():
            yield from join_leaves(mark, size, component, starts[small], counts[small], percent)
            for lo, n in zip(starts[(counts > 1) & ~small].tolist(), counts[(counts > 1) & ~small].tolist(), strict=True):
                own = slice(lo, lo + n)
                sides = side[own] if side[own].any() else None
                for i, j, most in join_group(mark[own], size[own], component[own], percent, sides):
                    yield lo + i, lo + j, most

        out, held = [], 0
        share, partner = np.zeros(len(token)), np.full(len(token), -1)  # of a set in a group
        for i, j, most in survivors():
            if one_partner:
                similar = most / (size[i] + size[j] - most)
                for x, y in ((i, j), (j, i)):  # the last of ascending values stays
                    up = np.argsort(similar, kind="stable")
                    up = up[similar[up] > share[x[up]]]
                    share[x[up]], partner[x[up]] = similar[up], y[up]
                continue
            out.append(np.stack([node[i], node[j]]))
            held += len(i)
            if held > 1 << 18:  # groups repeat pairs
                out = [np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)]
                held = out[0].shape[1] // 2
        if one_partner:
            has = np.flatnonzero(partner >= 0)
            out = [np.stack([node[partner[has]], node[has]])]
        both = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1) if out else np.zeros((2, 0), np.int64)
        both = both[:, both[0] != both[1]]
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("int")
    small = F.col("blocks") == 1
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a set of block b meets every block: pairs (b, other) with the lower block on side 0; tasks of small groups hold
    # the bins of one hash bucket, about 4 * block rows, and at most about 16 * block more
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.withColumn("side", F.when(low == high, 0).when(F.col("block") == low, 0).otherwise(1))
    total = members.count()
    bins = max(1, total // (4 * block))
    task = F.when(small, F.pmod("bin", F.lit(bins))).otherwise(F.xxhash64("token", low, high))
    rows = rows.withColumn("task", task).withColumn("many", ~small)
    return (
        rows.select("task", "many", "token", "side", "node", "size", "component", "mark")
        .groupBy("task", "many")
        .applyInArrow(run, "a long, b long")
        .distinct()
    )


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of classes whose exact sets are similar: a, b, overlap, union."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = shared_table(nodes.join(classes.select("node", *OF_SET), "node"))
    ids = wanted.select(F.col("doc").alias("_id")).distinct()
    bits, bitmap = _id_filter(ids)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            common, union = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(s[k].as_buffer(), np.uint64) for s in (a, b))
                common[k] = len(np.intersect1d(x, y, assume_unique=True))
                union[k] = len(x) + len(y) - common[k]
            kept = 100 * common >= percent * union
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[kept]) for c in ("a", "b")] + [pa.array(common[kept]), pa.array(union[kept])], ["a", "b", "overlap", "union"])

    # an id may have several texts; equal rows of one id give one set
    sets = _sets_of(docs, bits, bitmap, words).groupBy(*OF_SET).agg(F.first("shingles").alias("shingles"))
    own = shared_table(sets.join(wanted, OF_SET).select("node", "shingles"))
    left = own.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = own.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    found = shared_table(pairs.join(left, "a").join(right, "b").mapInArrow(overlap, "a long, b long, overlap long, union long"))
    drop_table(wanted, own)
    return found


def _sets_of(docs: DataFrame, bits: int, bitmap, words: int) -> DataFrame:
    """``doc, size, d1, d2, shingles`` of the documents that the filter lets through."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            cell = batch.column("_cell").to_numpy()
            batch = batch.filter(pa.array((held[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                hashes, at = shingle_sets(part.column("_text"), words)
                parts = [hashes[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                described = [part.column("_id"), pa.array(np.diff(at), pa.int64()), *map(pa.array, _digests(hashes, at))]
                yield pa.RecordBatch.from_arrays([*described, binary_column(parts)], [*OF_SET, "shingles"])

    celled = docs.where("_id is not null").select("_id", "_text", F.pmod(F.xxhash64("_id"), F.lit(bits)).alias("_cell"))
    return celled.mapInArrow(sets, "doc long, size long, d1 long, d2 long, shingles binary")


def _members_of_components(classes: DataFrame, labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Classes of components of several classes: node, doc, size, d1, d2, component, n (classes), total (shingles), ids."""
    labelled = classes.where("doc is not null").select("node", *OF_SET).join(labels, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node")).join(ids, OF_SET[1:])
    several = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    return shared_table(labelled.join(several, "component"))


def _overlaps(ids: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Common shingles of the sets i and j of each pair; ``ids``: the sets back to back, ``held``: zeros for every id."""
    order = np.argsort(i, kind="stable")
    out = np.zeros(len(i), np.int64)
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = ids[at[i[part[0]]] : at[i[part[0]] + 1]]
        held[own] = 1
        others = j[part]
        if 4 * len(others) > len(at):
            out[part] = np.add.reduceat(held[ids], at[:-1], dtype=np.int64)[others]
        else:
            out[part] = [np.count_nonzero(held[ids[at[k] : at[k + 1]]]) for k in others.tolist()]
        held[own] = 0
    return out


def _all_links(members: DataFrame, docs: DataFrame, words: int, percent: int, block: int, counted: bool) -> DataFrame:
    """Of every pair of classes of a component whose exact sets are similar: ``a, b, overlap, union``; ``counted``: instead
    ``node, n``, the ids with a set similar to a class's, in parts that are still to be summed."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("size", "ascending"), ("node", "ascending")]).combine_chunks()
        component, side, size, own, doc, many = (table.column(c).to_numpy() for c in ("component", "side", "size", "node", "doc", "ids"))
        parts = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        marks = [signature(p) for p in parts]
        at = np.r_[0, np.cumsum(size)]
        vocabulary, ids = np.unique(np.concatenate(parts), return_inverse=True)
        held = np.zeros(len(vocabulary), np.uint8)
        starts = np.r_[0, np.flatnonzero(np.diff(component)) + 1]
        counts = np.diff(np.r_[starts, len(component)])
        apart = np.arange(len(component))  # every set by itself: no pair is dropped
        sides = side if side.any() else None
        small = (counts > 1) & (counts <= LEAF) & (sides is None)

        def survivors():
            yield from join_leaves(marks, size, apart, starts[small], counts[small], percent)
            for lo, n in zip(starts[(counts > 1) & ~small].tolist(), counts[(counts > 1) & ~small].tolist(), strict=True):
                group = slice(lo, lo + n)
                for i, j, _ in join_group(marks[lo : lo + n], size[group], apart[group], percent, None if sides is None else sides[group]):
                    yield lo + i, lo + j

        linked, found = np.zeros(len(size), np.int64), []
        for pair in survivors():
            for lo in range(0, len(pair[0]), CHUNK):
                i, j = pair[0][lo : lo + CHUNK], pair[1][lo : lo + CHUNK]
                common = _overlaps(ids, at, i, j, held)
                union = size[i] + size[j] - common
                ok = 100 * common >= percent * union
                i, j = i[ok], j[ok]
                if counted:
                    np.add.at(linked, i, many[j])
                    np.add.at(linked, j, many[i])
                else:
                    found.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), common[ok], union[ok]]))
        if counted:
            has = np.flatnonzero(linked)
            return pa.table({"node": pa.array(own[has], pa.int64()), "n": pa.array(linked[has], pa.int64())})
        rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        return pa.table({name: pa.array(row, pa.int64()) for name, row in zip(("a", "b", "overlap", "union"), rows, strict=True)})

    bits, bitmap = _id_filter(members.select(F.col("doc").alias("_id")).distinct())
    rows = _sets_of(docs, bits, bitmap, words).join(members, OF_SET).dropDuplicates(OF_SET)
    # components of over 256 classes already are several tasks' work; large ones have blocks of at most about ``block`` classes
    several = F.greatest(F.ceil(F.col("n") / block), F.least(F.lit(8), F.ceil(F.col("n") / 256)), F.ceil(F.col("total") / BLOCK_SHINGLES))
    rows = rows.withColumn("blocks", several.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    total = members.agg(F.sum("size")).first()[0] or 0
    bin_ = F.pmod(F.xxhash64("component"), F.lit(max(1, total // TASK_SHINGLES)))
    rows = rows.withColumn("side", F.when(F.col("block") > F.col("other"), 1).otherwise(0))
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, bin_).otherwise(F.xxhash64("component", low, high))).withColumn("split", F.col("blocks") > 1)
    rows = rows.select("task", "split", "component", "side", "size", "node", "doc", "ids", "shingles")
    return rows.groupBy("task", "split").applyInArrow(run, "node long, n long" if counted else "a long, b long, overlap long, union long")


def _with_classes(described: DataFrame, of_class: DataFrame) -> DataFrame:
    """``described`` with the columns of each row's class.  Classes that hold more than 1/4096 of all rows (at most 4,096) are
    broadcast to their rows, so that no task gets all copies of a text; the rest meet by a shuffle."""
    key = OF_SET[1:]
    large = F.col("class_size") * HOT_SHARE > described.count()
    hot = F.broadcast(of_class.where(large))
    rest = described.join(hot.select(*key), key, "left_anti").join(of_class.where(~large), key, "left")
    return described.join(hot, key).unionByName(rest)


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    percent: int = 85,
    first_shingles: int = 6,
    merging_rounds: int = 2,
    block: int = 2048,
    all_links: bool = True,
    tag_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, links).  Documents: ``id_col, n_shingles, class_id, class_size, component_id, n_links``, one row per
    input row; ``class_id`` is the least id of the documents with the same set, ``component_id`` the least id reachable by
    links, ``n_links`` the number of other documents, by id and set, that link to the row's, those of the same set included.
    Links: ``a, b, overlap, union`` of all linked pairs of classes, by their representatives; they are found when read.
    Without ``all_links`` there is no ``n_links``, and the links are only enough of them to connect every component, by the
    numbers of their classes.  With ``tag_col`` (long, not null; tells the rows of one id apart) the documents have it too,
    and ``kept``: is the row its component's one of least (id, tag); rows without shingles or id are kept.

    Two documents link when ``100 * overlap >= percent * union`` of their sets of ``words``-word shingles (``percent`` over
    50).  Words are runs of other characters than space and 0x09-0x0D, lower-cased in A-Z only; with fewer words the whole
    sequence is the one shingle.  Null, empty or wordless text: no shingles, no links, a component of its own.  The nodes of
    the graph are the classes of equal sets, so rows that repeat an id with other texts are documents of their own.  Rows
    with a null id get the class, component and links of equal sets, else null.  Other columns are ignored.  Hashes have 64
    bits.
    """
    if percent <= 50:
        raise ValueError("percent has to be over 50")
    spark = docs.sparkSession
    tag = F.lit(0).cast("long") if tag_col is None else F.col(tag_col)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), tag.alias("_tag"))
    scanned = shared_table(_scan(docs, words))
    described = scanned.where("chunk is null").select("doc", "tag", "size", "d1", "d2")
    levels = spark.sparkContext.broadcast(_levels(scanned.where("chunk is not null").select("chunk", "salt", "counts")).tobytes())
    least = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "tag")))
    # written once, so that a class keeps its number
    classes = shared_table(
        _describe(docs, words, percent, levels)
        .groupBy("size", "d1", "d2")
        .agg(least.alias("least"), F.count(F.lit(1)).alias("class_size"), F.first("prefix").alias("prefix"), F.first("mark").alias("mark"))
        .select(F.monotonically_increasing_id().alias("node"), "least.doc", "least.tag", "size", "d1", "d2", "class_size", "prefix", "mark")
    )
    nodes = classes.where("doc is not null")
    # shingles that more than one set has among its first; one shuffle, read by both sides of the join
    tokens = nodes.select("node", F.posexplode("prefix").alias("at", "token")).repartition("token")
    common = tokens.groupBy("token").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.max("at").alias("_at")).where("_lo <> _hi")
    held = tokens.join(common, "token").select("token", "node", "at")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("at", "token"))
    held = shared_table(held.withColumn("nth", nth).drop("at"))

    def members(tokens: DataFrame) -> DataFrame:
        """Sets of the shingles that sets of several components share, with size and signature."""
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi")
        # groups with the same least component go to the same few tasks, which then repeat fewer pairs
        spread = shared.groupBy("_lo").agg(F.ceil(F.sum("n") / F.lit(16 * block)).alias("_parts")).where("_parts > 1")
        parts = F.coalesce("_parts", F.lit(1))  # only the few components of many sets are looked up, so a hot one isn't shuffled together
        shared = shared.join(spread, "_lo", "left").withColumn("bin", F.xxhash64("_lo", F.pmod(F.xxhash64("token"), parts)))
        rows = tokens.join(shared.select("token", "n", "bin"), "token")
        return shared_table(rows.join(nodes.select("node", "size", "mark"), "node").select("token", "n", "bin", "node", "size", "component", "mark"))

    links = labels = None
    for last in [False] * merging_rounds + [True]:
        part = held if last else held.where(F.col("nth") <= first_shingles)
        if labels is None:
            labelled = part.select("token", "node", F.col("node").alias("component"))
        else:
            labelled = part.join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
        gathered = members(labelled)
        found = shared_table(_candidates(gathered, percent, block, not last))
        verified = _verify(found, classes, docs, words, percent)
        drop_table(gathered, found)
        if links is not None:
            before, links = (links, verified), shared_table(links.unionByName(verified))
            drop_table(*before)
        else:
            links = verified
        last_labels, labels = labels, components(links)
        drop_table(last_labels)
    drop_table(held)
    reached = nodes.select("node", "doc", "tag").join(labels, "node").groupBy("component").agg(F.min(F.struct("doc", "tag")).alias("first"))
    of_class = classes.select("node", "size", "d1", "d2", "class_size", F.col("doc").alias("class_id"), F.col("tag").alias("class_tag"))
    of_class = of_class.join(labels, "node", "left").join(reached, "component", "left")
    out = [
        F.col("doc").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("first.doc", "class_id", "doc").alias("component_id"),
    ]
    if tag_col is not None:
        one = F.col("doc").isNull() | ((F.col("doc") == F.coalesce("first.doc", "class_id")) & (F.col("tag") == F.coalesce("first.tag", "class_tag")))
        out += [F.col("tag").alias(tag_col), F.coalesce(one, F.lit(True)).alias("kept")]
    if all_links:
        ids = described.where("doc is not null").select(*OF_SET).distinct().groupBy(*OF_SET[1:]).agg(F.count(F.lit(1)).alias("ids"))
        grouped = _members_of_components(classes, labels, ids)
        linked = _all_links(grouped, docs, words, percent, block, True).groupBy("node").agg(F.sum("n").alias("linked"))
        of_class = of_class.join(ids, OF_SET[1:], "left").join(linked, "node", "left")
        others = F.col("ids") - F.col("doc").isNotNull().cast("int") + F.coalesce("linked", F.lit(0))
        out.append(F.when(F.col("size") == 0, 0).otherwise(others).cast("long").alias("n_links"))
        links = _all_links(grouped, docs, words, percent, block, False).where("a <> b")
    return _with_classes(described, shared_table(of_class)).select(*out), links
