"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import os

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A tokenizer file that every executor can read; a parameter of everything that counts tokens.
TOKENIZER = os.environ.get("TRENDSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Texts encoded at a time, at most so many and so many characters (one text may have more).
TEXTS, CHARS = 256, 1_000_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def count(texts: list[str], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text; special tokens' strings count as ordinary text. Copies among the texts are encoded once."""
    out: list[int] = []
    some: list[str] = []
    held = 0
    once = dict.fromkeys(texts)
    for t in [*once, None]:
        if some and (t is None or len(some) >= TEXTS or held + len(t) > CHARS):
            out += [len(e.ids) for e in _tokenizer(path).encode_batch(some, add_special_tokens=False)]
            some, held = [], 0
        if t is not None:
            some.append(t)
            held += len(t)
    sizes = dict(zip(once, out))
    return [sizes[t] for t in texts]


def with_token_counts(df: DataFrame, text_col: str, path: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``df`` and the number of tokens of each text, 0 for a null or empty one. A column of that name is replaced."""

    @F.pandas_udf("bigint")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(count([t or "" for t in s], path), dtype="int64")

    return df.withColumn(name, counted(F.col(text_col)))
