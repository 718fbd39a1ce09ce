"""Vector columns in Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a batch of array<double>.

    Vectors that are null or empty, or hold null or non-finite entries, are left out.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)  # null entries become nan
        matrix = values.astype("f8").reshape(len(rows), n)
        whole = np.isfinite(matrix).all(axis=1)
        if whole.any():
            yield rows[whole], matrix[whole]
