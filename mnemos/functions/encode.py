"""Text to vector, as an Arrow function around the hashing kernel. Any pandas UDF string -> array<double> may stand in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemos.config import FIELD
from mnemos.kernels.hashing import encode_batch

#: Texts that are encoded at a time: their windows are kept in memory.
ROWS = 500


def encode_text(text: Column, dim: int = FIELD.latent_dim) -> Column:
    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([v for i in range(0, len(texts), ROWS) for v in encode_batch(texts.iloc[i : i + ROWS].tolist(), dim)], index=texts.index)

    return encode(text.cast("string"))
