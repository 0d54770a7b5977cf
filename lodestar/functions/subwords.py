"""Subword counts by a tokenizer file: what a model's window holds, where words are only an estimate.

A worker reads the file once for each path and counts whole Arrow batches; the library runs one thread for each task.
The path must be readable on every worker. A special token's string counts as that token, as in the library.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters encoded by one call of the library, so that a batch's encodings aren't all held at once.
CALL_CHARS = 1 << 20


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lengths(path: str, texts: list[str]) -> np.ndarray:
    """How many ids each text has, without special tokens added."""
    tokenizer = _tokenizer(path)
    out = np.zeros(len(texts), np.int64)
    low = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CALL_CHARS or i + 1 == len(texts):
            out[low : i + 1] = [len(x.ids) for x in tokenizer.encode_batch(texts[low : i + 1], add_special_tokens=False)]
            low, held = i + 1, 0
    return out


def subword_count(path: str) -> Callable[[Column], Column]:
    """A function from a text column to its count of ids; a null text has none."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(lengths(path, texts.fillna("").tolist()))

    return lambda text: count(text)
