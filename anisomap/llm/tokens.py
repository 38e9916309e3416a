"""Tokenizing columns of text with a public vocabulary file; tokenizers are never trained here."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The vocabulary's special token, whose id follows those of the ranks: a fixed value.
END_OF_TEXT = "<|endoftext|>"

_OPEN: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    """The byte-level encoder of a file of ranks, opened once in each process."""
    if (path, pattern) not in _OPEN:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {} if len(ranks) in ranks.values() else {END_OF_TEXT: len(ranks)}
        _OPEN[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _OPEN[path, pattern]


def encode(e, text: object) -> list[int]:
    """The ids of a text as the vocabulary's .json file gives them: its special token is one id wherever it stands in a text."""
    return e.encode(text, allowed_special="all", disallowed_special=()) if isinstance(text, str) else []


def public_ranks(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """(path, pattern) of a public byte-level vocabulary; the .tiktoken file has the ids of the .json file."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def ids_udf(path: str, pattern: str, end: int | None):
    """A Pandas UDF from text to its ids (and ``end``) as little-endian 16-bit integers, and their number."""

    @F.pandas_udf("ids binary, n long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e, last = encoder(path, pattern), [] if end is None else [end]
        for texts in batches:
            out = [np.array(encode(e, t) + last, "<u2") for t in texts]
            yield pd.DataFrame({"ids": [x.tobytes() for x in out], "n": np.array([len(x) for x in out], np.int64)})

    return coded

