"""Embedder slot: functions that add a vector column for a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], np.ndarray]
Embed = Callable[[DataFrame, str], DataFrame]


def hashing_embedding(dims: int = 64, name: str = "embedding") -> Embed:
    """Model-free default: hashed token counts of unit length, computed in the JVM."""

    def run(df: DataFrame, text: str) -> DataFrame:
        words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
        counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims).transform(
            df.withColumn("_words", words)
        )
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(name, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")

    return run


def model_embedding(load_model: Callable[[], Model], batch: int = 512, name: str = "embedding") -> Embed:
    """Vectors from a model plug-in, loaded once per Python worker and called with ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in rows], index=part.index)

    def run(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn(name, vectors(F.col(text)))

    return run
