"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: the pattern that splits text before byte-pair merges, as public byte-level vocabularies use it
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: characters of a text that are encoded at once: merges never cross the pattern's pieces, so a cut between pieces changes nothing
_BLOCK = 200_000


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file of ranks; each worker process loads it once."""
    import tiktoken

    lines = map(bytes.split, Path(path).read_bytes().splitlines())
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of the whole text; 0 for NULL. Strings of special tokens are ordinary text. Unpaired surrogates count as replacement characters."""
    if not text:
        return 0
    encode = encoding(path).encode_ordinary
    total = at = 0
    while len(text) - at > _BLOCK:
        # a newline behind a letter always begins a piece of its own
        cut = text.rfind("\n", at + 1, at + _BLOCK)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
            cut = text.rfind("\n", at + 1, cut)
        if cut <= at:
            break
        total, at = total + len(encode(text[at:cut])), cut
    return total + len(encode(text[at:]))


def token_counts(documents: DataFrame, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``documents`` without ``text``, with ``_tokens`` (bigint)."""
    kept = [c for c in documents.columns if c != text]
    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "_tokens bigint"])

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            n = pa.array([count(t.as_py(), path) for t in b.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], n], [*kept, "_tokens"])

    return documents.select(*kept, F.col(text)).mapInArrow(sizes, schema)
