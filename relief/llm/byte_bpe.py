"""Byte-level BPE over length-bucketed padded numpy matrices, and its decoding.

A text is split by a pattern; each distinct match becomes a row of a matrix of token ids, with the matches of similar
length.  In each round every row merges its leftmost pair of minimum rank; pairs are looked up in an open-addressing hash
table; merged columns are closed up and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relief.llm.common import binary_column, bounded_slices

NO_RANK = np.int32(np.iinfo(np.int32).max)
CELLS_PER_MATRIX = 1 << 20
#: bytes from which a match is merged by itself
LONG = 1 << 11


class PairTable:
    """Hash table from a pair of token ids to the id (rank) of the token that their bytes make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(2 * len(rank)).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        self.probes = 0
        keys = self._key(left, right)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # all keys at once: who finds its slot free and wins it is done, the others go one further
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.ranks[at[won]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK if it makes no token; negative ids are padding."""
        out = np.full(left.shape, NO_RANK, np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.ravel()[real], right.ravel()[real])
        slot = self._slot(keys)
        flat = out.ravel()
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            flat[real[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not more.any():
                break
            real, keys, slot = real[more], keys[more], (slot[more] + np.uint64(1)) & self.mask
        return flat.reshape(left.shape)


    def one(self, left: int, right: int) -> int:
        """As ``rank`` for a single pair of ids."""
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        for _ in range(self.probes):
            found = int(self.keys[slot])
            if found == key:
                return int(self.ranks[slot])
            if found == 0xFFFFFFFFFFFFFFFF:
                break
            slot = slot + 1 & int(self.mask)
        return int(NO_RANK)


class ByteBpe:
    """Vocabulary of a rank file: lines of base64 token and rank; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.known: dict[str, bytes] = {}

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> ByteBpe:
        """Kept, with its merged matches, between the tasks of a Python worker."""
        with open(path, "rb") as f:
            return ByteBpe({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def merge(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``ids``: rows padded with -1 on the right.  Yields (row numbers, their final ids, padded) as rows finish."""
        rows = np.arange(len(ids))
        rank = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)  # the leftmost of the least rank
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NO_RANK)
            live = best != NO_RANK
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                if not len(rows):
                    return
            n, width = ids.shape
            here = np.arange(n)
            # close up: column at + 1 goes, all behind it move one to the left
            keep = np.ones((n, width), bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[here, at] = False
            rank = rank[keep].reshape(n, width - 2)
            ids[here, at] = best
            # only the pairs on both sides of the merged token are new
            left = at > 0
            rank[here[left], at[left] - 1] = self.pairs.rank(ids[here[left], at[left] - 1], ids[here[left], at[left]])
            right = at < width - 2
            rank[here[right], at[right]] = self.pairs.rank(ids[here[right], at[right]], ids[here[right], at[right] + 1])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Final ids of one long row.  As ``merge``, but a merged token's place stays empty instead of closing up the row, and
        the least rank of every block of about the square root of the row's length is kept, so a round reads two blocks."""
        n = len(ids)
        width = 1 << (n.bit_length() + 1) // 2
        rank = np.full(-(-n // width) * width, NO_RANK, np.int32)
        rank[: n - 1] = self.pairs.rank(ids[:-1], ids[1:])
        blocks = rank.reshape(-1, width)
        least = blocks.min(1)
        token, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            block = int(least.argmin())
            if least[block] == NO_RANK:
                return np.array([t for t in token if t >= 0], ids.dtype)
            at = block * width + int(blocks[block].argmin())
            gone = after[at]
            token[at], token[gone] = int(rank[at]), -1
            after[at] = after[gone]
            touched = {at: NO_RANK, gone: NO_RANK}
            if after[at] < n:
                before[after[at]] = at
                touched[at] = self.pairs.one(token[at], token[after[at]])
            if before[at] >= 0:
                touched[before[at]] = self.pairs.one(token[before[at]], token[at])
            for place, value in touched.items():
                rank[place] = value
            for k in {place // width for place in touched}:
                least[k] = blocks[k].min()

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Ids of each match, as little-endian unsigned 32-bit integers."""
        raw = [m.encode("utf-8", "surrogatepass") for m in matches]
        out = [b""] * len(raw)
        todo = []
        for k, r in enumerate(raw):
            if (whole := self.ids.get(r)) is not None:  # a token as it stands
                out[k] = whole.to_bytes(4, "little")
            elif len(r) > LONG:
                out[k] = self.merge_long(self.byte[np.frombuffer(r, np.uint8)]).astype("<u4").tobytes()
            elif r:
                todo.append(k)
        lengths = np.array([len(raw[k]) for k in todo], np.int64)
        order = np.argsort(lengths, kind="stable")
        lo = 0
        while lo < len(order):
            # a bucket: lengths up to 5/4 of its least plus 3, and a bounded matrix
            least = int(lengths[order[lo]])
            hi = int(np.searchsorted(lengths[order], least + least // 4 + 3, side="right"))
            hi = min(hi, lo + max(1, CELLS_PER_MATRIX // (least + least // 4 + 3)))
            members = [todo[k] for k in order[lo:hi].tolist()]
            lo = hi
            width = len(raw[members[-1]])
            ids = np.full((len(members), width), -1, np.int32)
            size = np.array([len(raw[k]) for k in members])
            ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(raw[k] for k in members), np.uint8)]
            for rows, final in self.merge(ids):
                held = final >= 0
                flat, ends = final[held].astype("<u4").tobytes(), 4 * np.cumsum(held.sum(1))
                for row, a, b in zip(rows.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                    out[members[row]] = flat[a:b]
        return out

    def encode_texts(self, texts: list[str | None], cache: int = 400_000) -> list[bytes]:
        split = [self.pattern.findall(t or "") for t in texts]
        here = set(chain.from_iterable(split))
        new = list(here.difference(self.known))
        if len(self.known) + len(new) > cache:
            self.known.clear()
            new = list(here)
        self.known.update(zip(new, self.encode_matches(new), strict=True))
        return [b"".join(map(self.known.__getitem__, matches)) for matches in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_tokens, ids`` (binary, little-endian unsigned 32-bit).

    Null text: as empty, no tokens.  Null and repeated ids stay as they are; other columns are ignored.  A match is merged
    once per Python worker and kept (up to 400,000 matches, about 60 MB).  ``path`` has to exist on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path, pattern)
        for batch in batches:
            for part in bounded_slices(batch, "_text"):
                ids = bpe.encode_texts(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), binary_column(ids)], [id_col, "n_tokens", "ids"])

    columns = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return columns.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with its column ``ids`` and a column ``decoded`` (binary): the bytes of the tokens in order.

    Null ids give null bytes.  Invalid ids (outside the vocabulary) raise.
    """
    schema = encoded.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path, pattern)
        for batch in batches:
            for part in bounded_slices(batch, "ids"):
                out = [None if i is None else bpe.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, binary_column(out)], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, type(schema)([*schema.fields]).add("decoded", "binary"))
