"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; they stay where they are.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer as an encoding object."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (``row_key``, ``text`` and the columns ``keep``) with ``n_tokens`` in place of the
    text. Whole texts are encoded; null and empty texts have 0 tokens."""
    kept = docs.select("row_key", *keep, "text")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "text") + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load(folder, vocabulary)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield batch.drop(columns="text").assign(n_tokens=n)

    return kept.mapInPandas(run, schema)
