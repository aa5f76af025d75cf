"""Token sizes of texts under a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files; every executor has it.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How a byte-level vocabulary of 50,257 entries splits text before merging (fixed value of that vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Longest piece given to the tokenizer at once, cut at a blank; a longer run without blanks is cut anywhere.
PIECE = 100_000

_LOADED: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of ``path``, once for each worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def pieces(text: str) -> Iterator[str]:
    while len(text) > PIECE:
        cut = text.rfind(" ", PIECE // 2, PIECE)
        cut = PIECE if cut < 0 else cut
        yield text[:cut]
        text = text[cut:]
    yield text


def count(text: str, path: str = VOCABULARY) -> int:
    enc = encoder(path)
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def sized(df: DataFrame, text: str, into: str, path: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``df`` with the number of tokens of ``text`` under the free name ``into``; 0 for null and empty texts."""
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(into, T.IntegerType())])
    names = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [0 if not t else count(t, path) for t in batch.column(names.index(text)).to_pylist()]
            kept = [batch.column(names.index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int32())], names=[*(f.name for f in fields), into])

    return df.mapInArrow(run, schema)
