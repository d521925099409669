"""Merkle manifest of a dataset over SHA-256 midstates.

A node's digest is the SHA-256 of its children's digests as lowercase hex.  One hex digest is 64 bytes, exactly one block
of SHA-256, so the state before each child slot is eight words: every parent keeps a copy of them all.  To fold a
replaced leaf up to the root, the parent's state before the leaf's slot goes on with the replacement and the siblings to
its right only; what stands to its left is in the state already.  The compression runs in numpy over many nodes at once,
and the states travel between executors as plain bytes, which hashlib's objects can't.

Leaves are grouped by key (here: language) and ordered by id.  ``RUN ** LEVELS`` consecutive nodes of a key make a block,
which one task builds; the blocks' tops are the next layer's nodes.  Thus a tree of n leaves takes log(n) / log(512)
shuffles of ever fewer rows, no task holds more than a block, and a key with a third of all rows is just more blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relief.llm.common import shared_table

RUN = 8
LEVELS = 3
BLOCK = RUN**LEVELS
WORDS = 8
#: 32-bit words of one step of a path: slot, number of children, state before the slot, the children's digests
STEP = 2 + WORDS + RUN * WORDS
#: words before the steps: digest of the key's tree, digest of the whole
HEAD = 2 * WORDS


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: FIPS 180-4: the first 32 bits of the fractional parts of the primes' square and cube roots
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)[:, None]
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
#: 16 bits as four hex digits in one word
_digits = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_value = np.arange(1 << 16)
HEX = sum(_digits[(_value >> (4 * k)) & 15] << np.uint32(8 * k) for k in range(4)).astype(np.uint32)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One SHA-256 block for many states at once: ``state`` 8 x n, ``block`` 16 x n, both uint32."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
            w[t - 16] = None
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8 x n) as blocks of 64 hex digits (16 x n)."""
    return np.stack([HEX[digest >> np.uint32(16)], HEX[digest & np.uint32(0xFFFF)]], axis=1).reshape(16, -1)


def finish(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digest after ``count`` whole blocks: the padding block."""
    block = np.zeros((16, state.shape[1]), np.uint32)
    block[0] = 0x80000000
    block[15] = 512 * count
    return compress(state, block)


@dataclass
class Level:
    """Nodes of one level and their parents; nodes of finished trees are passed on as they are."""

    live: np.ndarray  # per node: does it have a parent
    parent: np.ndarray  # per node: its place in the next level
    slot: np.ndarray  # per node
    count: np.ndarray  # per parent: children
    children: np.ndarray  # RUN x 8 x parents
    states: np.ndarray  # RUN x 8 x parents: copy of the hash state before each slot

    def resume(self, node: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """Parents' digests with ``digest`` (8 x n) in the place of the nodes."""
        parent, slot = self.parent[node], self.slot[node]
        folded = resume(self.states[slot, :, parent].T, slot, self.count[parent], digest, self.children[:, :, parent])
        return np.where(self.live[node], folded, digest)


def resume(state: np.ndarray, slot: np.ndarray, count: np.ndarray, digest: np.ndarray, children: np.ndarray) -> np.ndarray:
    """From the states before ``slot``: the replacement, then the siblings to the right, then the padding."""
    state = state.copy()
    for k in range(RUN):
        on = np.flatnonzero((slot <= k) & (k < count))
        if len(on):
            state[:, on] = compress(state[:, on], hex_block(np.where(slot[on] == k, digest[:, on], children[k][:, on])))
    return finish(state, count)


def height(n: np.ndarray) -> np.ndarray:
    """Levels above ``n`` nodes: until one is left."""
    return sum((n > RUN**k).astype(np.int64) for k in range(21))


def climb(group: np.ndarray, pos: np.ndarray, n: np.ndarray, digest: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels of whole blocks (``group``: their ascending numbers), the place of each block's first node, the tops (8 x blocks)."""
    left = np.minimum(height(n), LEVELS)
    levels = []
    for step in range(LEVELS):
        live = left > step
        if not live.any():
            break
        up = np.where(live, pos // RUN, pos)
        first = np.ones(len(pos), bool)
        first[1:] = (group[1:] != group[:-1]) | (up[1:] != up[:-1])
        at, parent, slot = np.flatnonzero(first), np.cumsum(first) - 1, np.where(live, pos % RUN, 0)
        count, hashed = np.bincount(parent), live[at]
        children, states = np.zeros((RUN, WORDS, len(at)), np.uint32), np.zeros((RUN, WORDS, len(at)), np.uint32)
        children[slot, :, parent] = digest.T
        state = np.repeat(START, len(at), axis=1)
        for k in range(RUN):
            states[k] = state
            on = np.flatnonzero(hashed & (count > k))
            state[:, on] = compress(state[:, on], hex_block(children[k][:, on]))
        levels.append(Level(live, parent, slot, count, children, states))
        digest = np.where(hashed, finish(state, count), children[0])
        group, pos, left = group[at], up[at], left[at]
    return levels, digest


def ancestors(levels: list[Level], nodes: int) -> list[np.ndarray]:
    """Place of every node's ancestor in each level, itself first."""
    out = [np.arange(nodes)]
    for level in levels:
        out.append(level.parent[out[-1]])
    return out


def words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests of 32 bytes as 8 x n."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, WORDS).T


def raw(digest: np.ndarray) -> list[bytes]:
    data = np.ascontiguousarray(digest.T).astype(">u4").tobytes()
    return [data[k : k + 32] for k in range(0, len(data), 32)]


def whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Consecutive whole blocks of rows sorted by (key, block), and each row's number of its block in the table."""
    rest: pa.Table | None = None

    def numbers(t: pa.Table) -> np.ndarray:
        key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block = t.column("block").to_numpy()
        change = np.zeros(len(block), np.int64)
        change[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        return np.cumsum(change)

    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not rest.num_rows:
            continue
        group = numbers(rest)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield rest.slice(0, cut), group[:cut]
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest, numbers(rest)


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _tops(nodes: DataFrame) -> DataFrame:
    """The next layer: one node per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_blocks(batches):
            n = t.column("n").to_numpy()
            _, tops = climb(group, t.column("pos").to_numpy() % BLOCK, n, words(t.column("digest")))
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            key = t.column("key").combine_chunks().take(pa.array(at))
            yield pa.RecordBatch.from_arrays([key, t.column("block").combine_chunks().take(pa.array(at)), pa.array(-(-n[at] // BLOCK)), pa.array(raw(tops), pa.binary())], ["key", "pos", "n", "digest"])

    rows = nodes.select("key", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest")
    return _blocks(rows).mapInArrow(run, "key string, pos long, n long, digest binary")


def layers_of(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (key, pos, n, digest) and the layers above them, the last with one node per key."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(shared_table(_tops(out[-1].select("key", "pos", "n", "digest"))))
        most = -(-most // BLOCK)
    return out


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of blocks, each after the row of its block's path (``pos`` -1)."""
    below = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("path", F.lit(None).cast("binary"))
    above = paths.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
    return _blocks(below.unionByName(above, allowMissingColumns=True))


def _split(t: pa.Table, group: np.ndarray) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """Nodes, their blocks' numbers, and the blocks' paths."""
    pos = t.column("pos").to_numpy()
    paths = t.column("path").filter(pa.array(pos < 0)).to_pylist()
    return t.filter(pa.array(pos >= 0)), group[pos >= 0], paths


def _descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Path of every node of an inner layer: its steps inside its block, then its block's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_blocks(batches):
            t, group, above = _split(t, group)
            pos = t.column("pos").to_numpy()
            levels, _ = climb(group, pos % BLOCK, t.column("n").to_numpy(), words(t.column("digest")))
            own = ancestors(levels, len(pos))
            out = []
            for k in range(len(pos)):
                steps = []
                for level, place in zip(levels, own, strict=False):
                    node = place[k]
                    if level.live[node]:
                        p, s = level.parent[node], level.slot[node]
                        steps.append(np.r_[s, level.count[p], level.states[s, :, p], level.children[:, :, p].ravel()].astype(">u4").tobytes())
                tail = above[group[k]]
                out.append(tail[: 4 * HEAD] + b"".join(steps) + tail[4 * HEAD :])
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(pos), pa.array(out, pa.binary())], ["key", "pos", "path"])

    return _with_paths(nodes.select("key", "pos", "n", "digest"), paths).mapInArrow(run, "key string, pos long, path binary")


def _paths(layers: list[DataFrame], top: DataFrame, down_to: int) -> DataFrame:
    """Paths (key, pos, path) of the nodes of layer ``down_to``, from those of the last layer."""
    for nodes in reversed(layers[down_to:-1]):
        top = shared_table(_descend(nodes, top))
    return top


def fold(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """For every leaf (key, pos, n, digest, claimed, id): ``id, leaf, subroot, root, proof_sha256, folded_root`` as hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_blocks(batches):
            t, group, above = _split(t, group)
            leaf = words(t.column("digest"))
            levels, _ = climb(group, t.column("pos").to_numpy() % BLOCK, t.column("n").to_numpy(), leaf)
            own = ancestors(levels, leaf.shape[1])
            folded = words(t.column("claimed"))
            for level, node in zip(levels, own, strict=False):
                folded = level.resume(node, folded)
            # above its block, equal digests of a block have the same fold
            marked = np.r_[group[None].astype(np.uint32), folded].T.copy().view(np.dtype((np.void, 4 * (WORDS + 1)))).ravel()
            _, one, back = np.unique(marked, return_index=True, return_inverse=True)
            steps = [np.frombuffer(p, ">u4")[HEAD:].astype(np.uint32).reshape(-1, STEP) for p in above]
            depth = np.array([len(s) for s in steps])
            lane, digest = group[one], folded[:, one]
            for k in range(int(depth.max())):
                on = np.flatnonzero(depth[lane] > k)
                step = np.stack([steps[b][k] for b in lane[on].tolist()], axis=1)
                digest[:, on] = resume(step[2 : 2 + WORDS], step[0].astype(np.int64), step[1].astype(np.int64), digest[:, on], step[2 + WORDS :].reshape(RUN, WORDS, -1))
            roots = raw(digest)
            # proofs: the siblings' hex digests, level by level
            near = [(level, [b"".join(d.hex().encode() for d in raw(level.children[: level.count[p], :, p].T)) for p in range(len(level.count))]) for level in levels]
            far = [_siblings(s) for s in steps]
            proof = []
            for k, block in enumerate(group.tolist()):
                parts = hashlib.sha256()
                for (level, held), place in zip(near, own, strict=False):
                    node = place[k]
                    if level.live[node]:
                        all_, s = held[level.parent[node]], 64 * int(level.slot[node])
                        parts.update(all_[:s])
                        parts.update(all_[s + 64 :])
                parts.update(far[block])
                proof.append(parts.hexdigest())
            subroots, root = [p[:32].hex() for p in above], [p[32:64].hex() for p in above]
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("id").combine_chunks(),
                    pa.array([d.hex() for d in raw(leaf)], pa.string()),
                    pa.array([subroots[b] for b in group.tolist()], pa.string()),
                    pa.array([root[b] for b in group.tolist()], pa.string()),
                    pa.array(proof, pa.string()),
                    pa.array([roots[j].hex() for j in back.tolist()], pa.string()),
                ],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    rows = _with_paths(leaves.select("key", "pos", "n", "digest", "claimed", "id"), paths)
    return rows.mapInArrow(run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def _siblings(steps: np.ndarray) -> bytes:
    out = []
    for step in steps:
        digests = raw(step[2 + WORDS :].reshape(RUN, WORDS).T)[: step[1]]
        out += [d.hex().encode() for k, d in enumerate(digests) if k != step[0]]
    return b"".join(out)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (gapless from 0 in ``group``, by ``order``) and ``n`` (rows of the group).

    Rows are dealt into ranges of (group, order), written with their range's number, and counted per range; no task
    orders a whole group.  Rows that are equal in ``order`` are told apart by their place in the input.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = shared_table(tie.repartitionByRange(group, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    ranges = Window.partitionBy(group).orderBy("_part")
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(
        group,
        "_part",
        F.coalesce(F.sum("_c").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_c").over(Window.partitionBy(group)).alias("n"),
    )
    within = Window.partitionBy(group, "_part").orderBy(*order, "_tie")
    at = placed.withColumn("_at", F.row_number().over(within) - 1)
    return at.join(starts, [group, "_part"]).withColumn("pos", (F.col("_start") + F.col("_at")).cast("long")).drop("_at", "_start", "_part", "_tie")


def field(value: Column) -> Column:
    """A value as ``byte count:value``, null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of a row's fields; no two different rows have the same bytes to hash."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def manifest(rows: DataFrame, key: Column, id_: Column, leaf: Column, claimed: Column | None = None) -> DataFrame:
    """One row per input row: ``key, id, leaf, subroot, root, proof_sha256, folded_root`` (hex).

    ``leaf`` and ``claimed`` (default: ``leaf``) are digests as binary; ``folded_root`` is the root that ``claimed`` in the
    leaf's place gives with the leaf's siblings.  Leaves are ordered by ``id_`` (null first), ties by leaf and claimed;
    equal rows are leaves of their own.  A null key is a key, before all others; keys are ordered bytewise.  A key's only
    leaf is its subroot, the only subroot is the root.  An empty table has no root and gives no rows.
    """
    # "-" sorts before "=": the null key first, and never equal to a text
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))
    leaves = rows.select(named.alias("key"), id_.cast("long").alias("id"), leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed"))
    nodes = shared_table(numbered(shared_table(leaves), "key", ["id", "digest", "claimed"]))
    trees = layers_of(nodes)
    subroots = shared_table(numbered(trees[-1].select("key", "digest").withColumn("tree", F.lit("")), "tree", ["key"]))
    forest = layers_of(subroots.select(F.col("tree").alias("key"), "pos", "n", "digest"))
    top = forest[-1].select("key", "pos", F.unhex(F.lit("00" * 4 * HEAD)).alias("path"))
    above = _paths(forest, top, 0)
    root = forest[-1].first()
    heads = subroots.join(above.select("pos", "path"), "pos").select(
        "key",
        F.lit(0).cast("long").alias("pos"),
        F.concat("digest", F.unhex(F.lit(bytes(root.digest).hex() if root else "")), F.expr(f"substring(path, {4 * HEAD + 1})")).alias("path"),
    )
    # the paths of the leaves' blocks: of the first inner layer, or of the whole trees if no key has two leaves
    paths = _paths(trees, shared_table(heads), 1)
    return fold(nodes, paths)
