"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: A ``.tiktoken`` rank file or a ``.json`` tokenizer; the folder is a parameter of every operator that counts tokens.
TOKENIZER = os.environ.get("EDGELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the public split pattern of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str):
    """text -> number of tokens. Special-token strings in a text count as ordinary text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(enc.encode_ordinary(s))


def token_count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of the whole text; 0 for null or empty."""
    if not text:
        return 0
    return encoder(path)(text.encode("utf-8", "replace").decode("utf-8"))


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the token count of ``text`` (BIGINT, 0 for null or empty); the text itself is dropped."""
    src = df.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + f", `{name}` bigint"
    names = [*keep, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [token_count(t, path) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names)

    return src.mapInArrow(run, schema)
