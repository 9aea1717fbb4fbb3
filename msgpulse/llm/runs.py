"""Complete groups out of a partition that is sorted by its group columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first ``keys`` columns, one table for each run of them.

    Only the run at hand and the batch at hand are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            values = column.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        last = [column[-1].as_py() for column in held[-1].columns[:keys]] if held else None
        new[0] = last != [column[0].as_py() for column in batch.columns[:keys]]
        for start, end in pairwise([0, *(np.flatnonzero(new[1:]) + 1).tolist(), batch.num_rows]):
            if held and new[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
