"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files, on every machine of the cluster.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    """Number of tokens; 0 for null and empty text. Special tokens' strings are ordinary text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n_tokens) of every row; only the columns named are read."""
    path = os.path.join(folder, vocabulary)
    src = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("__text"))
    cols = [f for f in src.schema if f.name != "__text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(path)
        for b in batches:
            yield b.drop(columns="__text").assign(n_tokens=[len(e.encode_ordinary(t)) if t else 0 for t in b["__text"]])

    return src.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols) + ", n_tokens int")
