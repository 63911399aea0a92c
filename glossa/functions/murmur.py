"""MurmurHash3 (x86, 32 bits, seed 0) of strings, vectorised over numpy and as an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(values: list[bytes]) -> np.ndarray:
    """Unsigned hashes; the values are taken together by the number of their 4-byte blocks."""
    size = np.array([len(v) for v in values], np.int64)
    h = np.zeros(len(values), np.uint32)
    if not len(values):
        return h
    for blocks in np.unique(size // 4):
        at = np.flatnonzero(size // 4 == blocks)
        width = (int(blocks) + 1) * 4
        words = np.frombuffer(b"".join(values[i].ljust(width, b"\0") for i in at.tolist()), "<u4").reshape(len(at), -1)
        x = np.zeros(len(at), np.uint32)
        for j in range(int(blocks)):
            x ^= _rotate(words[:, j] * _C1, 15) * _C2
            x = _rotate(x, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        x ^= _rotate(words[:, -1] * _C1, 15) * _C2  # a tail of zeros adds nothing
        x ^= size[at].astype(np.uint32)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        h[at] = x ^ (x >> np.uint32(16))
    return h


@pandas_udf(LongType())
def murmur3_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hash of each string; null for null."""
    for s in batches:
        known = s.notna()
        out = pd.Series([None] * len(s), dtype="Int64")
        out[known.to_numpy()] = murmur3([v.encode() for v in s[known]]).astype(np.int64)
        yield out
