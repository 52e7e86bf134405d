"""Token identifiers to text by a public vocabulary, a file that every executor must be able to read.

Defined cases: null ids are left out; ids that the vocabulary lacks become the replacement character; the end id becomes a line end; a null array gives null.
"""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def vocabulary(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def decode_ids(ids, path: str = RANKS, end: int = 0) -> str:
    words = vocabulary(path)
    return b"".join(b"\n" if i == end else words.get(int(i), "\ufffd".encode()) for i in ids if i is not None and i == i).decode("utf-8", "replace")


def decoded(ids: Column | str, path: str = RANKS, end: int = 0) -> Column:
    """The text of each array of ids."""

    @F.pandas_udf("string")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else decode_ids(a, path, end) for a in arrays], dtype="object")

    return run(ids)


def token_ids(ids: Column) -> Column:
    """Ids as integers; null for arrays that are empty or have an element that is none."""
    own = F.transform(ids, lambda x: x.cast("string").try_cast("int"))
    return F.when((F.size(own) > 0) & ~F.exists(own, lambda x: x.isNull()), own)
