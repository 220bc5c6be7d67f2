"""Word and shingle hashes of whole Arrow batches, computed with array operations.

Words are the ones of :mod:`folioscope.llm.words`; a batch of texts becomes one
array of code points, so the cost per character is a few array passes instead
of a Python object per word.
"""

from __future__ import annotations

import functools

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@functools.cache
def _word_table() -> np.ndarray:
    return np.char.isalnum(np.arange(0x110000, dtype=np.uint32).view("U1"))


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate([out[:1], np.full(n - 1, _C)]), out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], together: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text).

    Texts of about ``together`` characters are hashed at once, so that the
    arrays stay in the processor's cache.
    """
    hashes, counts = [], []
    begin = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held > together or k == len(texts) - 1:
            some, n = _hash_together(texts[begin : k + 1])
            hashes.append(some)
            counts.append(n)
            begin, held = k + 1, 0
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def _hash_together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _word_table()[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(points))
    starts, ends = edge[::2], edge[1::2]
    counts = np.zeros(len(low), dtype=np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = ends - starts
    chars = points[inside].astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        chars = (chars + _A) * _powers(max(64, 1 << int(lengths.max()).bit_length()))[place]
        hashes = mix(np.add.reduceat(chars, first) + lengths.astype(np.uint64) * _B)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return hashes, np.bincount(owner, minlength=len(low))


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words within a text, number of runs of each text)."""
    runs = np.maximum(counts - k + 1, 0)
    if len(hashes) < k or not runs.any():
        return np.zeros(0, dtype=np.uint64), runs
    with np.errstate(over="ignore"):
        acc = hashes[: len(hashes) - k + 1].copy()
        for j in range(1, k):
            acc = acc * _A + hashes[j : len(hashes) - k + 1 + j]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[: len(acc)] - np.arange(len(acc))
    return mix(acc[left >= k]), runs


def text_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words."""
    out = []
    ends = np.cumsum(counts)
    place = np.arange(len(hashes)) - np.repeat(ends - counts, counts)
    filled = np.flatnonzero(counts)
    for salt in (_A, _B):
        key = np.zeros(len(counts), dtype=np.uint64)
        if len(filled):
            with np.errstate(over="ignore"):
                spread = mix(hashes ^ mix((place.astype(np.uint64) + np.uint64(1)) * salt))
                key[filled] = mix(np.add.reduceat(spread, (ends - counts)[filled]) * salt)
        out.append(key)
    return out[0], out[1]
