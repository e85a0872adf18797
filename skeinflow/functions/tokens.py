"""Lengths of texts in tokens of a public tokenizer, whose vocabulary file is a parameter; read once by each Python worker."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _tokenizer(file: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


class Counter:
    """Tokens of a text; may be passed to the chunkers in place of the rule of four characters."""

    def __init__(self, file: str = VOCABULARY):
        self.file = file

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.file).encode(text, add_special_tokens=False).ids)


def token_length(text: Column, file: str = VOCABULARY) -> Column:
    """Tokens of each text, null for null; a batch of Arrow is one call of the tokenizer."""

    @F.pandas_udf(T.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        there = texts.dropna()
        found = _tokenizer(file).encode_batch(there.tolist(), add_special_tokens=False)
        return pd.Series([len(f.ids) for f in found], index=there.index, dtype="float64").reindex(texts.index)

    return run(text)
