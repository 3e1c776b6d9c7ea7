"""Vector functions over array columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marketpulse.constants import EMBEDDING_DIM
from marketpulse.functions.binding import bind


# Vectors drawn at a time: their digests and numbers in double precision are many times as large as what is kept.
DRAWN_ROWS = 256


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    with_norm = bind(vector, lambda v: F.struct(v.alias("v"), l2_norm(v).alias("norm")))

    def scale(s: Column) -> Column:
        by = F.when(s["norm"] > 0, s["norm"]).otherwise(F.lit(1.0))
        return bind(F.struct(s["v"].alias("v"), by.alias("by")),
                     lambda t: F.transform(t["v"], lambda x: x.cast("double") / t["by"]))

    return bind(with_norm, scale)


def _gaussian_rows(seeds: list[str], dim: int) -> np.ndarray:
    """Standard-normal rows: every digest of seed and block number gives four 32-bit numbers, and the Box-Muller
    transform makes four normal ones of them."""
    blocks = -(-dim // 4)
    digests = b"".join(hashlib.md5(f"{seed}#{j}".encode()).digest() for seed in seeds for j in range(blocks))
    words = np.frombuffer(digests, dtype=">u4").astype(np.float64).reshape(len(seeds), blocks, 2, 2)
    radius = np.sqrt(-2.0 * np.log((words[..., 0] + 1.0) / 4294967296.0))
    angle = 2.0 * math.pi * words[..., 1] / 4294967296.0
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=-1).reshape(len(seeds), -1)[:, :dim]


def _units(batches: Iterator[pd.Series], dim: int) -> Iterator[pd.Series]:
    """Unit vectors of the seeds in single precision, handed on a few at a time; none where the seed is null."""
    for seeds in batches:
        for start in range(0, len(seeds), DRAWN_ROWS):
            some = seeds.iloc[start:start + DRAWN_ROWS]
            known = some.notna().to_numpy()
            out = pd.Series([None] * len(some), dtype=object)
            if known.any():
                rows = _gaussian_rows(some[known].tolist(), dim)
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                units = (rows / np.where(norms > 0, norms, 1.0)).astype(np.float32)
                out[np.flatnonzero(known)] = list(units)
            yield out


def hash_embedding(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Unit vector in single precision that depends on the text alone: the embedding used where no model is given.

    The whole text is hashed in the JVM; only the digest goes to Python, where some hundred vectors are drawn at once.
    Nested array functions could do the same, but are interpreted per element.
    """
    @F.pandas_udf("array<float>")
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _units(batches, dim)

    return draw(F.md5(text.cast("binary")))
