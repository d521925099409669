"""Vector bin packing of token sequences by the dot-product heuristic, streamed over each partition.

A sequence has three limits: tokens, segments and loss-bearing tokens.  Of a window of waiting pieces, the one whose
demand vector has the largest dot product with the sequence's free capacity vector (both in shares of the limits) is placed
next, until none fits; then, if pieces may be cut, the largest waiting piece fills the rest.  A task holds ``window`` pieces
and one Arrow batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relief.llm.common import binary_column, bounded_slices


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray  # uint32
    loss: np.ndarray | None  # per token; None: all bear loss
    total: int  # tokens of the whole document

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """Tokens of the longest prefix within both limits."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(self.loss[:n], dtype=np.int64), loss, side="right"))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head, tail = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.doc, self.start, self.ids[:n], head, self.total), Piece(self.doc, self.start + n, self.ids[n:], tail, self.total)


class Packer:
    """Waiting pieces and the sequences made of them."""

    def __init__(self, limits: Limits, window: int, cut: bool):
        self.limits, self.window, self.cut = limits, window, cut
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.waiting: list[Piece] = []
        self.need = np.zeros((window + 1, 3), np.int64)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        # what is too large for any sequence is cut in any case
        while len(piece.ids) >= self.limits.tokens or piece.demand()[2] > self.limits.loss:
            n = piece.fitting(self.limits.tokens, self.limits.loss)
            if n == len(piece.ids):
                break
            head, piece = piece.cut(n)
            yield from self._wait(head)
        if len(piece.ids):
            yield from self._wait(piece)

    def _wait(self, piece: Piece) -> Iterator[list[Piece]]:
        if len(piece.ids) == self.limits.tokens:
            yield [piece]
            return
        self.need[len(self.waiting)] = piece.demand()
        self.waiting.append(piece)
        if len(self.waiting) > self.window:
            yield from self._fill()

    def _take(self, k: int) -> Piece:
        piece, last = self.waiting[k], len(self.waiting) - 1
        self.waiting[k], self.need[k] = self.waiting[last], self.need[last]
        self.waiting.pop()
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        free, placed = self.cap.copy(), []
        share = 1.0 / self.cap
        while self.waiting:
            need = self.need[: len(self.waiting)]
            value = np.where((need <= free).all(1), need @ (free * share * share), -1.0)
            best = int(value.argmax())
            if value[best] < 0:
                break
            piece = self._take(best)
            free -= piece.demand()
            placed.append(piece)
        if self.cut and self.waiting and free[0] and free[1]:
            k = int(self.need[: len(self.waiting), 0].argmax())
            n = self.waiting[k].fitting(int(free[0]), int(free[2]))
            if 0 < n < len(self.waiting[k].ids):
                head, rest = self._take(k).cut(n)
                placed.append(head)
                self.need[len(self.waiting)] = rest.demand()
                self.waiting.append(rest)
        yield from self._whole(placed)

    def _whole(self, placed: list[Piece]) -> Iterator[list[Piece]]:
        """A sequence that stayed short, as sequences whose lengths are powers of two (these need no padding)."""
        left = sum(len(p.ids) for p in placed)
        if not self.cut or left == self.limits.tokens:
            yield placed
            return
        queue = placed[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part = []
            while room:
                piece = queue.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    queue.append(rest)
                room -= len(piece.ids)
                part.append(piece)
            yield part

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield from self._fill()


def pack(
    docs: DataFrame,
    encode: Callable[[], Callable[[pa.Array], list[np.ndarray]]],
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    limits: Limits = Limits(),
    window: int = 512,
    cut: bool = True,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id, offset``.

    ``encode`` is called once per task and returns a function from a column of texts (null: empty) to the token ids of
    each row.  ``loss_col`` (array of int, as long as the row's ids) marks loss-bearing tokens; without it, or where it is
    null, all are.  A row without ids gives no piece.  Null and repeated ids are kept as they are, each row being a document of
    its own.  Other columns are ignored.  Sequence ids are unique (partition number and a counter), not gapless.  Each
    partition is packed by itself, in its order, without a shuffle; with ``cut`` its last sequences are cut to powers of
    two, so the number of partitions adds no padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encode()
        packer, number = Packer(limits, window, cut), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, start, length, ids, total, seq, offset = zip(*rows, strict=True)
            rows.clear()
            arrays = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary_column(list(ids)), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def keep(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for p in sequence:
                    rows.append((p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, number, at))
                    at += len(p.ids)
                number += 1

        for batch in batches:
            for part in bounded_slices(batch, "_text", 1 << 20):
                loss = part.column("_loss").to_pylist() if loss_col else [None] * part.num_rows
                for doc, ids, mask in zip(part.column("_id").to_pylist(), to_ids(part.column("_text")), loss, strict=True):
                    keep(packer.add(Piece(doc, 0, ids, None if mask is None else np.asarray(mask, np.int64), len(ids))))
                if len(rows) >= 1024:
                    yield flush()
        keep(packer.finish())
        if rows:
            yield flush()

    columns = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")] + ([F.col(loss_col).alias("_loss")] if loss_col else [])
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


#: a character that is a pre-token by itself between spaces; words that hold it are encoded one by one
SEPARATOR = "\x01"
MARKS = ".,;:!?#$%&*"


def folded(text: str) -> str:
    """Lower case where that is the same character by character (up to U+00FF); other texts are left to the tokenizer."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


#: words and their ids by tokenizer file, kept between the tasks of a Python worker
_known: dict[str, dict[str, bytes]] = {}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def encode_words(tokenizer, words: list[str], together: int = 256) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit; many words go through the tokenizer as one text."""
    mark = tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
    plain = [w for w in words if SEPARATOR not in w] if len(mark) == 1 else []
    out: dict[str, bytes] = {}
    chunks = [plain[lo : lo + together] for lo in range(0, len(plain), together)]
    texts = [f" {SEPARATOR} ".join(chunk) for chunk in chunks]
    for chunk, encoding in zip(chunks, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        ids = np.array([*encoding.ids, mark[0]], "<u4")
        ends = np.flatnonzero(ids == mark[0])
        raw = ids.tobytes()
        starts = np.r_[0, ends[:-1] + 1]
        out.update((w, raw[a:b]) for w, a, b in zip(chunk, (4 * starts).tolist(), (4 * ends).tolist(), strict=True))
    rest = [w for w in words if w not in out]
    for w, encoding in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        out[w] = np.array(encoding.ids, "<u4").tobytes()
    return [out[w] for w in words]


def word_encoder(path: str, end_id: int | None = None, cache_words: int = 1_000_000):
    """For ``pack``: ids of a ``tokenizers`` file, plus ``end_id`` after each text.

    The file has to lower-case, and to make runs of letters, single digits, and runs of other marks pre-tokens of their own.

    Each distinct space-separated word is encoded once and kept; beyond ``cache_words`` (about 200 MB) the older half goes.
    Strings of special tokens inside texts are ordinary text.
    """

    def make():
        tokenizer = _tokenizer(path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        known = _known.setdefault(path, {})

        def encode(texts: pa.Array) -> list[np.ndarray]:
            split = [folded(t or "").replace("\n", " ").split(" ") for t in texts.to_pylist()]
            if len(known) > cache_words:
                for w in list(islice(known, len(known) // 2)):
                    del known[w]
            new = set(chain.from_iterable(split)).difference(known)
            # marks at the end of a word are a pre-token of their own: their ids follow the bare word's
            ended = {w: (bare, w[len(bare) :]) for w in new if len(bare := w.rstrip(MARKS)) < len(w) and bare[-1:].isalnum() and bare[-1] <= "\xff"}
            parts = list((new.difference(ended) | set(chain.from_iterable(ended.values()))).difference(known))
            known.update(zip(parts, encode_words(tokenizer, parts), strict=True))
            known.update((w, known[bare] + known[marks]) for w, (bare, marks) in ended.items())
            return [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, "<u4") for words in split]

        return encode

    return make
