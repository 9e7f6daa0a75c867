"""Redaction of Arrow batches in slices."""

import pandas as pd
import pyarrow as pa

from sessionloom.functions import redaction, scanner

SECRETS, SHAPE = redaction._SECRETS, redaction._SHAPE


def test_a_batch_of_texts_is_read_in_slices():
    """However many texts a batch holds, only a slice of them are strings at a time; the result is that of all at once."""
    texts, sizes = [None, "", "mail a@b.co", "password=hunter2hunter2"] * 300, []
    whole = scanner.metadata(pd.Series(texts, dtype=object), SECRETS, SHAPE, 20)

    def counted(part, **fixed):
        sizes.append(len(part))
        return scanner.metadata(part, **fixed)

    kind = pa.struct([("clean", pa.string()), ("truncated", pa.bool_()), ("counts", pa.list_(pa.int32()))])
    run = scanner.column_of(counted, kind, steps=SECRETS, shape=SHAPE, limit=20)
    assert run(pa.array(texts)).to_pylist() == whole.to_dict("records")
    assert sum(sizes) == len(texts) and max(sizes) <= 256
    assert run(pa.array([], pa.string())).to_pylist() == []
