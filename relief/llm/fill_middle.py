"""Fill-in-the-middle by in-place block rotation.

A text's bytes lie in one bytearray, with the three sentinels inserted at its cuts:
``<P>prefix<M>middle<S>suffix``.  Both output orders are this buffer with one block moved behind its neighbour; the two
neighbours are exchanged by three reversals (each block by itself, then both together).  Restoring finds the sentinels,
exchanges the same blocks back and takes the sentinels out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relief.llm.common import binary_column, bounded_slices

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: bytes that a reversal or a scan holds beside the buffer
CHUNK = 1 << 16


@dataclass(frozen=True)
class Plan:
    """Sentinels, percentages and the seed of the cuts.  A text that holds a sentinel stays plain."""

    prefix: bytes = b"<P>"
    middle: bytes = b"<M>"
    suffix: bytes = b"<S>"
    transformed_percent: int = 90
    spm_percent: int = 20
    seed: str = "1"

    def __post_init__(self):
        marks = (self.prefix, self.middle, self.suffix)
        for i, a in enumerate(marks):
            # where an end of one is a beginning of another, a border of text and sentinel could look like a sentinel
            if not a or any((i != j and b in a) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) for j, b in enumerate(marks)):
                raise ValueError("sentinels must not be empty, equal or overlap each other")

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers under 2**32 from the document's id (null: no digits)."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse ``view[lo:hi]`` in place, a chunk from both ends at a time."""
    while hi - lo > 1:
        k = min(CHUNK, (hi - lo) // 2)
        head = view[lo : lo + k].copy()
        view[lo : lo + k] = view[hi - k : hi][::-1]
        view[hi - k : hi] = head[::-1]
        lo, hi = lo + k, hi - k


def exchange(view: np.ndarray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring blocks ``[lo, mid)`` and ``[mid, hi)`` in place by three reversals."""
    reverse(view, lo, mid)
    reverse(view, mid, hi)
    reverse(view, lo, hi)


def count_points(view: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all but continuation bytes."""
    return sum(int(np.count_nonzero((view[at : at + CHUNK] & 0xC0) != 0x80)) for at in range(0, len(view), CHUNK))


def byte_of_point(view: np.ndarray, points: list[int]) -> list[int]:
    """Byte offsets of the given code points (ascending; the text's length is its end)."""
    out, seen = [], 0
    for at in range(0, len(view), CHUNK):
        starts = np.flatnonzero((view[at : at + CHUNK] & 0xC0) != 0x80)
        while len(out) < len(points) and points[len(out)] < seen + len(starts):
            out.append(at + int(starts[points[len(out)] - seen]))
        seen += len(starts)
        if len(out) == len(points):
            return out
    return out + [len(view)] * (len(points) - len(out))


def transform_text(text: bytes, doc_id: int | None, plan: Plan) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, code points of the text, form, code points of prefix and of middle)."""
    scan = np.frombuffer(text, np.uint8)
    n = count_points(scan)
    h1, h2, h3, h4 = plan.draws(doc_id)
    if not n or h3 % 100 >= plan.transformed_percent or any(mark in text for mark in (plan.prefix, plan.middle, plan.suffix)):
        return text, n, PLAIN, None, None
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut1, cut2 = byte_of_point(scan, [one, two])
    buffer = bytearray(text)
    buffer[cut2:cut2] = plan.suffix
    buffer[cut1:cut1] = plan.middle
    buffer[0:0] = plan.prefix
    middle_at = len(plan.prefix) + cut1
    suffix_at = len(plan.prefix) + len(plan.middle) + cut2
    form = SPM if h4 % 100 < plan.spm_percent else PSM
    exchange(np.frombuffer(buffer, np.uint8), 0 if form == SPM else middle_at, suffix_at, len(buffer))
    return bytes(buffer), n, form, one, two - one


def restore_text(output: bytes, form: str, plan: Plan) -> bytes:
    """The text from its output and form alone."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    if form == PSM:
        lo, mid = buffer.index(plan.suffix), buffer.index(plan.middle)
    else:
        lo, mid = 0, buffer.index(plan.prefix)
    exchange(np.frombuffer(buffer, np.uint8), lo, mid, len(buffer))
    for mark in (plan.suffix, plan.middle, plan.prefix):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def transform(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n, form, prefix_chars, middle_chars, output`` (string).

    Null text: as empty.  Empty texts and texts that hold a sentinel stay ``plain`` with null counts.  Equal ids are cut
    at equal shares only if their texts are equally long; a null id draws from the seed alone.  Other columns are
    ignored, whatever their names.  Every row is handled by itself, texts of up to 2 MB together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "_text"):
                ids = part.column("_id")
                done = [transform_text(t or b"", i, plan) for i, t in zip(ids.to_pylist(), part.column("_text").to_pylist(), strict=True)]
                output, n, form, prefix, middle = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), binary_column(list(output))],
                    [id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    done = rows.mapInArrow(run, f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restore(formed: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``formed`` (any columns, ``output`` and ``form`` among them) with the column ``restored``: the text as it was.

    Null outputs give null.
    """
    schema = formed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "output"):
                pairs = zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True)
                texts = [None if o is None else restore_text(o.encode("utf-8", "surrogatepass"), f, plan).decode("utf-8", "surrogatepass") for o, f in pairs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "restored"])

    return formed.mapInArrow(run, type(schema)([*schema.fields]).add("restored", "string"))
