"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (ranks, one base64 token and its rank a line); every executor must be able to read it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that comes with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of every document; a null text has none. Texts that look special are plain text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(t)) for t in pdf.pop("text")]
            yield pdf

    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    types = dict(rows.dtypes)
    return rows.mapInPandas(count, ", ".join([*(f"{c} {types[c]}" for c in keep), "n_tokens long"]))
