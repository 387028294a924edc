"""Arrow batches cut into portions of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked off at once in a Python worker.
PORTION = 2 << 20


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in runs of about size bytes of the
    column; a longer value is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
