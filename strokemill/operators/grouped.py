"""Work on many small drawings at a time: whole drawings come in Arrow tables of some thousand rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(ids: pa.Array, before: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """(where another value begins, the last value); ``before`` is the value before the first one."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    value, null = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())
    out = np.ones(len(value), bool)
    out[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    out[0] = before is None or (value[0], null[0]) != before
    return out, (value[-1], null[-1])


def whole_drawings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole drawings from batches that are sorted by drawing; what ends in a later batch is held back."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        new, last = changes(batch.column("drawing_id"), last)
        if not new.any():
            held.append(batch)
            continue
        cut = int(np.flatnonzero(new)[-1])
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def on_drawings(df: DataFrame, order: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on tables of whole drawings, sorted by drawing_id and ``order``. A call of its own for each
    drawing would cost more than the work on it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_drawings(batches):
            yield from run(table).to_batches()

    own = df.repartition("drawing_id").sortWithinPartitions("drawing_id", F.col(order).asc_nulls_last())
    return own.mapInArrow(each, schema)
