"""Vector columns as matrices, and which vectors take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    inner = vector.cast("array<double>")
    good = F.forall(inner, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def matrix(lists: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter vectors are padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width or 0, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out
