"""Vectors of texts by a pluggable encoder.

An encoder turns a list of texts into as many vectors. hash_encoder needs no
model: it hashes the trigrams of a text, so that texts with common parts have
similar vectors. Scores of vectors come from the strategy EMBEDDING.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(size: int = 256) -> Encoder:
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            padded = f"  {' '.join(text.lower().split())}  "
            for j in range(len(padded) - 2):
                out[i, xxhash.xxh3_64_intdigest(padded[j : j + 3].encode()) % size] += 1.0
        return out

    return encode


def with_vectors(df: DataFrame, text: str, vector: str, encoder: Encoder) -> DataFrame:
    """df with a column of vectors (array<double>) of its texts. A null text has
    a null vector; the encoder is called once a batch with all other texts, and
    loaded once in a worker if it keeps what it loads."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                out[known] = pd.Series([v.tolist() for v in np.asarray(encoder(batch[known].tolist()), dtype=float)], index=batch.index[known], dtype=object)
            yield out

    return df.withColumn(vector, encode.asNondeterministic()(F.col(text)))
