"""The one redaction step SQL has no function for: Unicode composition.

The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def compose_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda text: None if text is None else unicodedata.normalize("NFC", text))
