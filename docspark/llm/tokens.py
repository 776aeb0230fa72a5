"""Token counts by a public tokenizer's rank file, whose path is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """``DOCSPARK_TOKENIZER``, else the byte-level file of the installed collection of public tokenizers."""
    named = os.environ.get("DOCSPARK_TOKENIZER")
    if named:
        return named
    found = importlib.util.find_spec("public_tokenizers")
    if found is None or found.origin is None:
        raise FileNotFoundError("name a tokenizer's rank file in DOCSPARK_TOKENIZER or as a parameter")
    return os.path.join(os.path.dirname(found.origin), "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """One tokenizer per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            # lone surrogates and the like are counted as replacement characters
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in pdf["text"]]})

    return run


def token_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``documents(doc_id, source, text)`` -> ``(doc_id, source, tokens)``; null and empty texts have 0."""
    return documents.select("doc_id", "source", "text").mapInPandas(_sizes(path or default_path()), "doc_id bigint, source string, tokens bigint")
