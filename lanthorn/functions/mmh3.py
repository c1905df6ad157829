"""32-bit MurmurHash3 (x86 variant) of byte strings, a batch at a time, as signed decimal text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _scramble(k: np.ndarray) -> np.ndarray:
    return _rot(k * _C1, 15) * _C2


def mmh3_batch(data: Sequence[bytes], seed: int = 0) -> np.ndarray:
    """Signed 32-bit hashes of all byte strings; block j of all strings that have one is mixed at once."""
    n = len(data)
    lens = np.array([len(d) for d in data], np.int64)
    h = np.full(n, seed, np.uint32)
    if n == 0:
        return h.view(np.int32)
    order = np.argsort(-lens, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lens[:-1])])
    buf = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8)
    whole = lens // 4
    with np.errstate(over="ignore"):
        for j in range(int(whole.max())):
            live = order[: np.searchsorted(-whole[order], -j, side="left")]
            at = starts[live] + 4 * j
            k = buf[at] | buf[at + 1].astype(np.uint32) << np.uint32(8) | buf[at + 2].astype(np.uint32) << np.uint32(16) | buf[at + 3].astype(np.uint32) << np.uint32(24)
            h[live] = _rot(h[live] ^ _scramble(k.astype(np.uint32)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        tail = lens % 4
        at = starts + 4 * whole
        k = np.zeros(n, np.uint32)
        for i in range(3):
            has = tail > i
            k[has] |= buf[at[has] + i].astype(np.uint32) << np.uint32(8 * i)
        h ^= np.where(tail > 0, _scramble(k), np.uint32(0))
        h ^= lens.astype(np.uint32)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def mmh3(col: Column, wrapped: bool = False, seed: int = 0) -> Column:
    """Hash of a binary or string column as decimal text; null stays null.

    ``wrapped`` hashes the base64 text with a line break after every 76 characters and at the end, the form that
    public icon catalogues use; the default hashes the bytes as they are.
    """

    @F.pandas_udf("string")
    def run(s):
        import base64

        import pandas as pd

        data = [b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in s]
        if wrapped:
            data = [base64.encodebytes(d) for d in data]
        out = mmh3_batch(data, seed)
        return pd.Series([None if x is None else str(int(h)) for x, h in zip(s, out)], dtype=object)

    return run(col)
