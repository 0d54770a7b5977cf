"""Adapters for neural models: each loads its model once for each worker and works on Arrow batches.

``load`` returns a plain function over lists, so any library can stand behind it. None is installed here; the
adapters are tested with stubs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.functions.vector import MIN_NORM

EMBED_BATCH = 32


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A function from a text column to unit vectors; a null text is embedded as an empty one."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            texts = texts.fillna("").tolist()
            rows = [np.asarray(encode(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            found = np.concatenate(rows) if rows else np.zeros((0, 1), np.float32)
            yield pd.Series(list(found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), MIN_NORM)))

    return lambda text: embed(text)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in: how many distinct tokens fall into each of ``dim`` hash buckets, as a unit vector."""
    buckets = F.transform(F.array_distinct(tokenize(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(counts, lambda x: (x / F.greatest(length, F.lit(MIN_NORM))).cast("float"))


def model_generator(load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 8) -> Callable[[Column], Column]:
    """A function from a prompt column to generated texts."""

    @F.pandas_udf("string")
    def generate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = load()
        for prompts in parts:
            prompts = prompts.fillna("").tolist()
            yield pd.Series([x for i in range(0, len(prompts), batch) for x in answer(prompts[i : i + batch])], dtype="object")

    return lambda prompt: generate(prompt)
