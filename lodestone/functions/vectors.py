"""Vectors: inner products, norms and a text encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The L2 norm, 1 for a zero vector."""
    n = F.sqrt(inner(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def normalized(values: list[float]) -> list[float]:
    n = float(np.linalg.norm(np.asarray(values, np.float64)))
    return [float(x) / (n or 1.0) for x in values]


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine with a query vector, as an expression."""
    return inner(a, F.array(*(F.lit(x) for x in normalized(query)))) / norm(a)


def cosine_arrow(query: list[float]) -> Callable[[Column], Column]:
    """The same through Arrow batches and one matrix product a batch; far faster on many vectors."""
    q = np.array(normalized(query))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if not len(rows):
                yield pd.Series([], dtype="float64")
                continue
            m = np.stack(rows.to_numpy()).astype(np.float64)
            n = np.linalg.norm(m, axis=1)
            yield pd.Series(m @ q / np.where(n == 0, 1, n))

    return score


def hashing_encoder(dim: int = 384) -> Callable[[pd.Series], np.ndarray]:
    """Signed counts of word and word-pair hashes: deterministic, needs no model file."""

    def encode(texts: pd.Series) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(texts), dim), np.float32)
        for k, text in enumerate(texts):
            words = re.findall(r"[^\W_]+", (text or "").lower())
            for w in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))):
                h = xxhash.xxh64_intdigest(w)
                out[k, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return encode


def encoded(text: Column, encoder: Callable[[pd.Series], np.ndarray]) -> Column:
    """A text column's vectors; any encoder of a batch of texts will do, and each worker keeps its own."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder(texts)), dtype=object)

    return run(text)
