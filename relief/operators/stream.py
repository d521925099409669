"""Arrow streams of rows sorted by a group: whole groups at a time, whatever the batches' borders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grouped(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with all rows of a group next to each other in one partition, in ``order``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Ascending number of each row's group; the rows of a group are neighbours.  Nulls are a value of their own."""
    change = np.zeros(t.num_rows, np.int64)
    for name in keys:
        codes = t.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the rows' group numbers; what is held back is the last group of a batch."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not rest.num_rows:
            continue
        numbers = group_numbers(rest, keys)
        cut = int(np.searchsorted(numbers, numbers[-1]))
        if cut:
            yield rest.slice(0, cut).combine_chunks(), numbers[:cut]
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), group_numbers(rest, keys)


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))
