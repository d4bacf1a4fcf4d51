"""Arrow batches cut by rows and bytes, so that long texts do not add up in one step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer single text is a step of its own.
STEP_BYTES = 4_000_000


def steps(batch: pa.RecordBatch, columns: list[int], rows: int, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes in the text ``columns``."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        total += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64)
    ends = np.cumsum(total)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, before + size, side="right"))
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
