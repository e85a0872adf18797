"""Vectors of texts without a model: words hashed into dimensions, of norm 1; the same in every session. Another embedder may be passed wherever one is used."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
_WORD = re.compile(r"[a-z0-9]+")
Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """(texts, dimensions): each word adds 1 or -1 to the dimension its hash names; a text without words is zero."""
    places: dict[str, tuple[int, int]] = {}
    out = np.zeros((len(texts), dimensions))
    for row, text in enumerate(texts):
        for word in _WORD.findall(text.lower()):
            if word not in places:
                digest = hashlib.md5(word.encode()).hexdigest()
                places[word] = (int(digest[:7], 16) % dimensions, 1 if int(digest[7], 16) < 8 else -1)
            at, sign = places[word]
            out[row, at] += sign
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(text: Column, embedder: Embedder = hashed) -> Column:
    """The vector of a text, null for null; a batch of Arrow is one call of the embedder."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna().to_numpy()
        found = iter(embedder(texts[there].tolist()).astype(np.float32)) if there.any() else iter(())
        return pd.Series([next(found) if t else None for t in there], dtype=object)

    return run(text)
