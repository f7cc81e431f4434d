"""Sizes of texts in tokens of a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless a caller says otherwise; the file is read on every executor, never copied.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: How the byte-level vocabularies cut a text before merging. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(path: str = DEFAULT_VOCABULARY) -> object:
    """The encoder of a .tiktoken file, loaded once in a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of each text; 0 for an empty text, null for a null one. Marks of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return run(text)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows in several tasks a core, so that one file of long texts doesn't fill a single task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, key)
