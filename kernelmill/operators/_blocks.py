"""Numeric helpers that run inside tasks, over blocks of coded strings."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def letter_matrix(vectors: np.ndarray, sigma_c: float) -> np.ndarray:
    """Similarity of all letters, with a zero row and column for the padding code -1."""
    d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(-1)
    out = np.zeros((len(vectors) + 1,) * 2)
    out[:-1, :-1] = np.exp(-d / (2 * sigma_c**2))
    return out


def padded(codes: list) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes), default=0)), -1, np.int64)
    for k, c in enumerate(codes):
        out[k, : len(c)] = c
    return out


def position_matrix(rows: int, cols: int, sigma_p: float) -> np.ndarray:
    return np.exp(-((np.arange(rows)[:, None] - np.arange(cols)[None, :]) ** 2) / (2 * sigma_p**2))


def _diagonals(s: np.ndarray, n: int) -> np.ndarray:
    """Sum over lengths up to n of the products along the diagonal from each cell; the last two axes are positions."""
    b = s.copy()
    for _ in range(n - 1):
        grown = np.ones_like(b)
        grown[..., :-1, :-1] += b[..., 1:, 1:]
        b = s * grown
    return b


def pair_kernel(x: np.ndarray, z: np.ndarray, letters: np.ndarray, sigma_p: float, n: int) -> np.ndarray:
    """[len(x), len(z)] kernel values of padded codes, a slab of rows at a time."""
    p = position_matrix(x.shape[1], z.shape[1], sigma_p)
    out = np.zeros((len(x), len(z)))
    step = max(1, 4_000_000 // max(1, len(z) * x.shape[1] * z.shape[1]))
    for k in range(0, len(x), step):
        s = letters[x[k : k + step, None, :, None], z[None, :, None, :]]
        out[k : k + step] = np.einsum("abij,ij->ab", _diagonals(s, n), p)
    return out


def self_kernel(x: np.ndarray, letters: np.ndarray, sigma_p: float, n: int) -> np.ndarray:
    """Kernel of each padded string with itself."""
    p = position_matrix(x.shape[1], x.shape[1], sigma_p)
    out = np.zeros(len(x))
    step = max(1, 4_000_000 // max(1, x.shape[1] ** 2))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        out[k : k + step] = np.einsum("aij,ij->a", _diagonals(letters[part[:, :, None], part[:, None, :]], n), p)
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as Spark does: halves of the shortest decimal that is x go away from zero."""
    t = np.abs(x) * 10.0**digits
    low = np.floor(t)
    out = (low + (t - low >= 0.5)) / 10.0**digits
    near = np.nonzero(np.isfinite(x) & ((np.abs(t - low - 0.5) < 1e-3) | (t >= 2**40)))  # there the product's rounding may decide
    out[near] = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in np.abs(x[near]).tolist()]
    return np.where(np.isfinite(x), np.sign(x) * out + 0.0, x)
