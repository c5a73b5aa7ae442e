"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file stays where it is."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary used unless another path is given.
DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Longer texts are encoded in pieces, cut only where the tokenizer's own pattern cuts, so that counts are those of the whole text.
PIECE = 1 << 20


@lru_cache(maxsize=4)
def _encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(DEFAULT), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cuts(text: str, k: int) -> bool:
    """Whether a token surely starts at ``k``: behind a line end and before no blank, or at a lone blank between words."""
    return text[k - 1] == "\n" and not text[k].isspace() or text[k] == " " and not text[k - 1].isspace() and not text[k + 1 : k + 2].isspace()


def count_tokens(text: str | None, path: str | None = None) -> int:
    """Tokens of ``text``; 0 for null and empty."""
    encoding, n, at = _encoding(path), 0, 0
    text = text or ""
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):  # the last such place in the piece, else the first behind it
            stop = next((k for k in range(stop, at, -1) if _cuts(text, k)), None) or next((k for k in range(stop, len(text)) if _cuts(text, k)), len(text))
        n += len(encoding.encode_ordinary(text[at:stop]))
        at = stop
    return n


def token_count(text: Column, path: str | None = None) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text)
