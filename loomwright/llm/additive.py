"""Additive quantisation: a vector is the sum of one full-dimensional code word from each codebook.

Codebooks start as residual k-means, then alternate beam-search encoding with updates of one
codebook after the other, each least squares given the rest. Numpy only; the same input
gives the same codebooks.
"""

from __future__ import annotations

import numpy as np


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        to = np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        n = np.bincount(to, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, to, x)
        full = n > 0
        centres[full] = total[full] / n[full, None]
        centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = 8, chunk: int = 2048) -> np.ndarray:
    """Codes (n, M) by beam search: after each codebook the partial sums nearest to x stay."""
    m, k, d = books.shape
    books = books.astype(np.float32)
    own = (books**2).sum(2)
    out = np.empty((len(x), m), np.uint8)
    for at in range(0, len(x), chunk):
        rest = x[at : at + chunk, None].astype(np.float32)  # what each partial sum leaves of x: (n, beam, d)
        n = len(rest)
        row = np.arange(n)[:, None]
        codes = np.zeros((n, 1, 0), np.uint8)
        for b in range(m):
            left = (rest**2).sum(2, keepdims=True)
            cost = (left + own[b] - 2 * (rest.reshape(-1, d) @ books[b].T).reshape(n, -1, k)).reshape(n, -1)
            keep = min(1 if b == m - 1 else beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(keep), (n, 1))
            word = best % k
            codes = np.concatenate([codes[row, best // k], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[row, best // k] - books[b][word]
        out[at : at + n] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def train(x: np.ndarray, m: int = 8, k: int = 256, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (m, k, d) for the rows of x; fewer code words where x has fewer rows."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    k = max(1, min(k, len(x)))
    rest, books = x.copy(), []
    for _ in range(m):
        c = _kmeans(rest, k, 6, rng)
        books.append(c)
        rest -= c[np.argmin((c**2).sum(1)[None] - 2 * rest @ c.T, axis=1)]
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books, beam=4)
        rest = x - decode(codes, books)
        for b in range(m):
            # Each word moves to the mean of what the other codebooks leave to it.
            n = np.bincount(codes[:, b], minlength=k)
            total = np.zeros((k, x.shape[1]))
            np.add.at(total, codes[:, b], rest)
            step = total / np.maximum(n, 1)[:, None]
            books[b] += step
            rest -= step[codes[:, b]]
    return books


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of each query with each code word: (n, m, k)."""
    return np.einsum("nd,mkd->nmk", queries, books, optimize=True)


def scores(lookup: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Estimated inner products (queries, vectors): sums of table entries times the stored norms."""
    out = np.zeros((len(lookup), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        out += lookup[:, b].take(codes[:, b], axis=1)
    return out * norms[None]
