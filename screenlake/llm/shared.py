"""Packed text arrays, next to the library's stages and components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.operators.graph import components
from screenlake.stages import Stages, shared_dir

__all__ = ["SPACE", "Stages", "aside", "components", "mix", "shared_dir", "slices", "texts_of", "words"]


def aside(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named like one of ``made`` put aside, and the columns that bring them back afterwards."""
    low = {m.lower() for m in made}
    names = {c: f"__own_{c}" for c in docs.columns if c.lower() in low}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


# --- packed texts -------------------------------------------------------------------------------------------------


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to
    trim()


def trim() -> None:
    """Gives memory that is free by now back to the system; a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


_R = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[SPACE] = 0
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_R), pow(int(_R), -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def words(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word `[^\\x20\\x09-\\x0D]+` of the texts in turn, and words per text. fold: A-Z as a-z."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    table = _FOLDED if fold else _BYTES
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    pw, inverse = _power(len(buf))
    total = np.cumsum(table[buf] * pw[: len(buf)])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes = mix((total[ends - 1] - before) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds))
