"""Hashes of word sequences for whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .encoding import chunked

_FACTOR = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, one to one."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (n x 2) of the words between ASCII white space of the texts (null: empty), and where each text's begin."""
    words, codes, bounds = chunked(pc.fill_null(texts, ""))
    own = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.encode("utf-8", "replace")) for w in words]), "<u8").reshape(-1, 2)
    return own[codes], bounds


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, put together from those of 1, 2, 4 ... values."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    made, done, step, size = np.zeros(n, np.uint64), 0, hashes, 1
    while True:
        factor = np.uint64(pow(_FACTOR, size, 1 << 64))
        if k & size:
            made = made * factor + step[done : done + n]
            done += size
        if done == k:
            return made
        step, size = step[:-size] * factor + step[size:], 2 * size


def sliding(least: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, k: int) -> np.ndarray:
    """least (np.minimum or np.maximum) over each k consecutive values."""
    size = 1
    while 2 * size <= k:
        x, size = least(x[:-size], x[size:]), 2 * size
    return least(x[: len(x) - (k - size)], x[k - size :]) if size < k else x


def text_numbers(bounds: np.ndarray) -> np.ndarray:
    """The number of the text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
