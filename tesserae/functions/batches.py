"""Parts of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of input and rows that a Python function turns into objects at once.
BYTES, ROWS = 1 << 20, 256


def in_ranges(batches: Iterable[pa.RecordBatch], size: int = BYTES, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches, cut into row ranges of at most this size, or single rows, so that what is made of a range stays small however many and long the rows of a batch are."""
    for batch in batches:
        start, n = 0, min(rows, batch.num_rows)
        while start < batch.num_rows:
            part = batch.slice(start, n)
            if part.nbytes > size and part.num_rows > 1:
                n = part.num_rows // 2
                continue
            yield part
            start, n = start + part.num_rows, min(rows, 2 * n)
