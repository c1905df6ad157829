"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

The vocabulary file's path is a parameter; each Python worker loads it once. A null or empty text has 0 tokens; texts are
encoded whole, special-token strings as ordinary text.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str):
    """The encoding of a rank file, kept for the life of the worker process."""
    kept = sys.modules.setdefault("_lanthorn_kept", types.ModuleType("_lanthorn_kept"))
    encodings = kept.__dict__.setdefault("encodings", {})
    if path not in encodings:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encodings[path] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encodings[path]


def count_tokens(docs: DataFrame, ids: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``ids`` and n_tokens of every row."""
    src = docs.select(*ids, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            n = [len(bpe.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=[*ids, "n_tokens"])

    return src.mapInArrow(run, schema)
