"""Sizes of texts in tokens of a public tokenizer; its files are read, never trained or copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder and file of the vocabulary, as ranks of byte sequences; both can be passed instead.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# How this vocabulary's texts fall into words before their bytes are merged.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return tiktoken.Encoding("inkwell", pat_str=WORDS, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in rows}, special_tokens={})


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; strings of special tokens are ordinary text."""
    encoding = _encoding(path)
    return [len(encoding.encode_ordinary(t)) for t in texts]


def with_tokens(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the size of ``text``; null counts as empty, 0."""
    path = os.path.join(folder, file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(n_tokens=count_tokens(b["text"].fillna("").tolist(), path))

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"
    return documents.select(*keep, F.col("text")).mapInPandas(run, schema)
