"""Arrow batches in pieces of bounded size, so that a worker's memory doesn't follow the size of its rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a text column that are worked on before their rows are handed on; a larger row goes alone.
PORTION = 1 << 22


def portions(b: pa.RecordBatch, name: str, size: int = PORTION):
    """A batch in pieces of about ``size`` bytes of a column."""
    n = pc.binary_length(b.column(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // size)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
        yield b.slice(low, high - low)
