"""Skip-gram vectors with negative sampling, learned from the counts of all word pairs in a window.

The loss of skip-gram with negative sampling depends on the pairs only through
their counts, so it is minimised over the table of (word, context word) counts
instead of over the text.  The vectors of the context words, the most frequent
words, are learned on the driver from a table of fixed size; with those held,
the vector of every other word is a small convex problem of its own, which the
executors solve for all words at once.

The inner product of a word's and a context word's vector estimates their
pointwise mutual information.
"""

from __future__ import annotations

import numpy as np

#: Words whose counts are summed and solved together.
BLOCK = 1_024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn_contexts(counts: np.ndarray, width: int = 24, steps: int = 80, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Vectors of the context words (columns) from counts of frequent words (rows) with them, by full-batch Adam."""
    words, contexts = counts.shape
    total = counts.sum()
    rng = np.random.default_rng(0)
    both = [rng.normal(0, 0.3, (words, width)), rng.normal(0, 0.3, (contexts, width))]
    if not total:
        return both[1]
    noise = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0, keepdims=True) / total
    # a cell's weight grows slower than its count, as words are thinned out in training
    weight = 1 / np.sqrt(np.maximum(counts + noise, 1.0))
    first = [np.zeros_like(m) for m in both]
    second = [np.zeros_like(m) for m in both]
    for step in range(1, steps + 1):
        word, context = both
        chance = _sigmoid(word @ context.T)
        slope = (counts * (1 - chance) - noise * chance) * weight
        for k, grad in enumerate((slope @ context - ridge * word, slope.T @ word - ridge * context)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            both[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return both[1]


def solve_words(counts: np.ndarray, share: np.ndarray, context: np.ndarray, rounds: int = 5, ridge: float = 1.0) -> np.ndarray:
    """Vectors of words (rows of counts) with the context vectors held: Newton steps of the same loss."""
    out = np.zeros((len(counts), context.shape[1]))
    noise = counts.sum(axis=1, keepdims=True) * share[None, :]
    pairs = (context[:, :, None] * context[:, None, :]).reshape(len(context), -1)
    eye = ridge * np.eye(context.shape[1])
    for _ in range(rounds):
        chance = _sigmoid(out @ context.T)
        grad = (counts * (1 - chance) - noise * chance) @ context - ridge * out
        curve = (((counts + noise) * chance * (1 - chance)) @ pairs).reshape(len(counts), *eye.shape) + eye
        step = np.linalg.solve(curve, grad[:, :, None])[:, :, 0]
        out += step * np.minimum(1, 4 / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-9))
    return out


def context_evidence(vectors: np.ndarray, near: np.ndarray, limit: float = 2.0) -> np.ndarray:
    """How much each candidate's vector speaks for it beside the given context vectors, within +-limit.

    Neighbours repeat one another, so their sum counts half.
    """
    if not len(near) or not len(vectors):
        return np.zeros(len(vectors))
    return np.clip(np.clip(vectors @ near.T, -2, 2).sum(axis=1) / 2, -limit, limit)
