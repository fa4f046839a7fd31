"""Kernels as SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import classify, container
from ..operators.transforms import KERNELS


def register(spark: SparkSession, prefix: str = "block_") -> list[str]:
    """Registers ``block_kind``, ``block_entropy``, ``block_compress``, ``block_decompress`` and each
    transform with its inverse; returns their names."""
    made = {}

    def scalar(name: str, kind: str, f) -> None:
        @F.pandas_udf(kind)
        def run(cells: pd.Series) -> pd.Series:
            return cells.map(lambda x: None if x is None else f(bytes(x)))

        made[prefix + name] = run

    scalar("kind", "string", classify.classify)
    scalar("entropy", "double", lambda b: classify.measure(b)[1])
    scalar("compress", "binary", container.compress)
    scalar("decompress", "binary", container.decompress)
    for name, (there, back) in KERNELS.items():
        scalar(name, "binary", there)
        scalar(name + "_inverse", "binary", back)
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)
