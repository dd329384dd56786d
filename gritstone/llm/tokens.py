"""Exact token counts by a public byte-level BPE vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.llm.common import arrow_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary at ``path`` (lines of base64 token and rank), read once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, *others: str) -> DataFrame:
    """doc_id, the other columns named, and n_tokens of the whole text (0 for null); rows without a doc_id go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *others)), pa.array(n)], ["doc_id", *others, "n_tokens"])

    kept = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), *others, F.col("text").cast("string").alias("text"))
    schema = kept.drop("text").schema.add("n_tokens", T.LongType())
    return arrow_batches(kept, count, schema)
