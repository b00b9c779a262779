"""Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches, column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices whose texts in a column have `most` bytes together (a longer text is a slice
    of its own), so that what Python makes of a slice doesn't grow with the rows of a batch. A batch without rows stays."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends) or not len(ends):
            begun = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begun + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
            if not len(ends):
                break
