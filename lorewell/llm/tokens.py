"""Sizes of texts in tokens of a public tokenizer, whose files stay where they are (parameter `folder`)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the published vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str = FOLDER):
    """The tokenizer, loaded once a worker."""
    import tiktoken

    path = f"{folder}/{RANKS}"
    with open(path if os.path.exists(path) else SparkFiles.get(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    encode = encoding(folder).encode_ordinary
    for batch in batches:
        sizes = [len(encode(text)) if text else 0 for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(sizes, np.int64))], names=["id", "tokens"])


def token_counts(texts: DataFrame, id_col: str, text_col: str, folder: str = FOLDER) -> DataFrame:
    """(id, tokens) of whole texts; a null or empty text has 0."""
    context = texts.sparkSession.sparkContext
    if not context.master.startswith("local["):
        context.addFile(f"{folder}/{RANKS}")  # for workers on machines without the folder
    slim = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(partial(_count, folder=folder), "id long, tokens long")
