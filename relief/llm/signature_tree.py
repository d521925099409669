"""Signature trees over shingle sets and their dual traversal (numpy, one group of sets at a time).

A set's signature is a bitmap with bit ``shingle mod width`` set.  A tree node holds the OR of the signatures below it,
their range of sizes and their least number of set bits.  For sets a below node A and b below node B, at least
``bits(a) - bits(A and B)`` shingles of a are not in b, so the overlap of a and b is at most
``max size(A) - max(0, least bits(A) - bits(A and B))`` and likewise from B.  A pair of nodes is dropped when that is less
than the overlap that the similarity needs at their least sizes.  No pair that is similar enough is ever dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 16
FANOUT = 8
CHUNK = 1 << 16


def signature_width(size: int) -> int:
    """Bits of a set's signature: the power of two from twice its size, 256 to 65,536."""
    return min(1 << 16, max(256, 1 << (2 * size - 1).bit_length()))


def signature(shingles: np.ndarray) -> bytes:
    bits = np.zeros(signature_width(len(shingles)), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Level:
    """The nodes of one level: OR of the signatures, least and greatest size, least number of bits, component."""

    union: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bits: np.ndarray
    component: np.ndarray


def fold(signatures: np.ndarray) -> np.ndarray:
    """Signatures of half the width."""
    half = signatures.shape[1] // 2
    return signatures[:, :half] | signatures[:, half:]


def build(signatures: np.ndarray, sizes: np.ndarray, component: np.ndarray, leaves_only: bool = False) -> list[Level]:
    """Levels from the sets, in their order, up to one root; a node has FANOUT children, above the sets LEAF."""
    levels = [Level(signatures, sizes, sizes, np.bitwise_count(signatures).sum(1, dtype=np.int64), component)]
    while len(levels[-1].low) > 1 and not leaves_only:
        below, step = levels[-1], LEAF if len(levels) == 1 else FANOUT
        cuts = np.arange(0, len(below.low), step)
        one = np.minimum.reduceat(below.component, cuts)
        levels.append(
            Level(
                np.bitwise_or.reduceat(below.union, cuts, axis=0),
                np.minimum.reduceat(below.low, cuts),
                np.maximum.reduceat(below.high, cuts),
                np.minimum.reduceat(below.bits, cuts),
                np.where(one == np.maximum.reduceat(below.component, cuts), one, -1),
            )
        )
    return levels


def keeps(a: Level, i: np.ndarray, b: Level, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs (i of a, j of b) can hold a pair of ``100 * overlap >= percent * union`` across components, and the
    greatest overlap that they allow."""
    low, high = np.minimum(a.high[i], b.high[j]), np.maximum(a.low[i], b.low[j])
    keep = (100 * low >= percent * high) & ((a.component[i] != b.component[j]) | (a.component[i] == -1))
    most = np.zeros(len(i), np.int64)
    step = max(1, (1 << 19) // a.union.shape[1])  # bitmaps of 4 MB at once
    for lo in range(0, len(i), step):
        k = lo + np.flatnonzero(keep[lo : lo + step])
        x, y = i[k], j[k]
        common = np.bitwise_count(a.union[x] & b.union[y]).sum(1, dtype=np.int64)
        most[k] = np.minimum(a.high[x] - np.maximum(0, a.bits[x] - common), b.high[y] - np.maximum(0, b.bits[y] - common))
        keep[k] = (100 + percent) * most[k] >= percent * (a.low[x] + b.low[y])
    return keep, most


def traverse(a: list[Level], b: list[Level], percent: int):
    """Yield arrays (i, j, greatest overlap) of set pairs that survive; for ``a is b`` each unordered pair once, no set with
    itself."""
    own = a is b
    top = max(len(a), len(b)) - 1
    stack = [(min(top, len(a) - 1), min(top, len(b) - 1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        ok, most = keeps(a[la], i, b[lb], j, percent)
        if own:
            ok = ok | (i == j) if la else ok & (i < j)
        i, j = i[ok], j[ok]
        if la == lb == 0:
            if len(i):
                yield i, j, most[ok]
            continue
        if not len(i):
            continue
        # the higher side is opened; both, if they are level
        da, db = la >= lb and la > 0, lb >= la and lb > 0
        na = (LEAF if la == 1 else FANOUT) if da else 1
        nb = (LEAF if lb == 1 else FANOUT) if db else 1
        step = max(1, CHUNK // (na * nb))
        for lo in range(0, len(i), step):
            x = (i[lo : lo + step, None] * na + np.arange(na))[:, :, None]
            y = (j[lo : lo + step, None] * nb + np.arange(nb))[:, None, :]
            x, y = np.broadcast_arrays(x, y)
            x, y = x.ravel(), y.ravel()
            inside = (x < len(a[la - da].low)) & (y < len(b[lb - db].low))
            if own and la - da == lb - db:
                inside &= x <= y
            stack.append((la - da, lb - db, x[inside], y[inside]))


def join_group(signatures: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int, side: np.ndarray | None = None):
    """Yield arrays (i, j, greatest overlap) of the pairs of a group that can be similar and are in different components.

    Sets of one signature width share a tree; widths a factor two apart are compared at the narrower (sets further
    apart in size can't be similar, for ``percent`` over 50).  ``side`` (0 or 1): only pairs across sides.
    """
    widths = np.fromiter(map(len, signatures), np.int64, len(signatures))
    order = np.lexsort((np.arange(len(sizes)), sizes, widths))

    def part(width: int, which: int | None, folded: bool = False):
        at = order[(widths[order] == width) & (True if which is None else side[order] == which)]
        if not len(at):
            return at, []
        bitmaps = np.frombuffer(b"".join(signatures[k] for k in at), np.uint64).reshape(len(at), -1)
        return at, build(fold(bitmaps) if folded else bitmaps, sizes[at], component[at])

    for width in np.unique(widths).tolist():
        left, right = (None, None) if side is None else (0, 1)
        pairs = [(part(width, left), None if side is None else part(width, right))]
        pairs.append((part(width, left), part(2 * width, right, True)))
        if side is not None:
            pairs.append((part(2 * width, left, True), part(width, right)))
        for (ia, a), other in pairs:
            ib, b = (ia, a) if other is None else other
            if a and b:
                for i, j, most in traverse(a, b, percent):
                    yield ia[i], ib[j], most


def join_leaves(signatures: list[bytes], sizes: np.ndarray, component: np.ndarray, starts: np.ndarray, counts: np.ndarray, percent: int):
    """As ``join_group`` for many groups of at most LEAF sets each (from ``starts``, ``counts`` long): trees of a single leaf,
    whose pairs are all compared at once."""
    firsts, seconds = [], []
    for n in np.unique(counts).tolist():
        i, j = np.triu_indices(n, 1)
        at = starts[counts == n][:, None]
        firsts.append((at + i).ravel())
        seconds.append((at + j).ravel())
    if not firsts:
        return
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    can = (100 * low >= percent * high) & (component[i] != component[j])
    i, j = i[can], j[can]
    widths = np.fromiter(map(len, signatures), np.int64, len(signatures))
    wide = widths[i] > widths[j]
    i, j = np.where(wide, j, i), np.where(wide, i, j)  # i is the narrower, if they differ
    place = np.zeros(len(widths), np.int64)
    for width in np.unique(widths[i]).tolist():

        def level(held: np.ndarray, folded: bool) -> Level:
            place[held] = np.arange(len(held))
            bitmaps = np.frombuffer(b"".join([signatures[k] for k in held.tolist()]), np.uint64).reshape(len(held), -1)
            return build(fold(bitmaps) if folded else bitmaps, sizes[held], component[held], leaves_only=True)[0]

        for folded in (False, True):
            pick = (widths[i] == width) & (widths[j] == (2 * width if folded else width))
            for lo in range(0, int(pick.sum()), CHUNK):  # bitmaps of a bounded number of pairs
                k = np.flatnonzero(pick)[lo : lo + CHUNK]
                x, y = i[k], j[k]
                if folded:
                    a = level(np.unique(x), False)
                    px = place[x]
                    b = level(np.unique(y), True)
                    py = place[y]
                else:
                    a = b = level(np.unique(np.r_[x, y]), False)
                    px, py = place[x], place[y]
                ok, most = keeps(a, px, b, py, percent)
                if ok.any():
                    yield x[ok], y[ok], most[ok]
