"""Sizes of texts in tokens of a public tokenizer. The vocabulary file's path is a parameter; nothing is trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("PLUMBLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: how text is split before the merges of byte-level rank files (a fixed value of that vocabulary)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 20_000  # longer texts are encoded piece by piece, cut before a blank, where the pattern splits anyway


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = TOKENIZER) -> int:
    enc, n, at = encoder(path), 0, 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        n += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(enc.encode_ordinary(text[at:]))


def sizes(df: DataFrame, key: str, text: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """key, the kept columns and n_tokens, which replaces a column of that name; null texts have none."""
    names = [n for n in dict.fromkeys([key, *keep]) if n != "n_tokens"]
    slim = df.select(*names, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [0 if t is None else count(t, path) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return slim.mapInArrow(run, df.select(*names, F.lit(0).cast("long").alias("n_tokens")).schema)
