"""Leading eigenpairs of a symmetric matrix: tridiagonal form, bisection on Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonalize(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): Householder reflections, each stored as the unit vector over the entries it turns."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        x[0] += np.copysign(norm, x[0])
        length = np.linalg.norm(x)
        v = x / length if length else x
        reflectors.append(v)
        if not length:
            continue
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``: negative pivots of the shifted matrix."""
    floor = np.finfo(float).tiny ** 0.5
    squares = off * off
    count = np.zeros(len(at), dtype=np.int64)
    q = np.ones(len(at))
    for i in range(len(diagonal)):
        q = diagonal[i] - at - (squares[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < floor, -floor, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval holds no further double."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0)) if n > 1 else np.zeros(1)
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    spare = EPS * max(np.abs(low).max(), np.abs(high).max()) + np.finfo(float).tiny
    low, high = low - spare, high + spare
    below = n - np.arange(1, k + 1)  # eigenvalues smaller than the wanted one
    for _ in range(2000):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = sturm_count(diagonal, off, middle) > below
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; pivots below ``least`` are replaced by it."""
    n = len(diagonal)
    d, b = (diagonal - shift).tolist(), right.tolist()
    upper, second, lower = [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            d[i], lower[i] = lower[i], d[i]
            upper[i], d[i + 1] = d[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(d[i]) < least:
            d[i] = least
        factor = lower[i] / d[i]
        d[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        b[i + 1] -= factor * b[i]
    if abs(d[-1]) < least:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        rest = b[i] - (upper[i] * b[i + 1] if i + 1 < n else 0.0) - (second[i] * b[i + 2] if i + 2 < n else 0.0)
        b[i] = rest / d[i]
    return np.array(b)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors, one per column, by inverse iteration from fixed random starts.

    Vectors of a cluster (values closer than a thousandth of the matrix's norm) are made orthogonal to those before them
    in every round, and equal values are moved apart by a few units in the last place.
    """
    n, random = len(diagonal), np.random.default_rng(0)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0.0, np.finfo(float).tiny)
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        shift = min(value, shift - 10 * EPS * norm) if j > first else value
        x = random.uniform(-1, 1, n)
        for _ in range(rounds):
            x = solve_shifted(diagonal, off, shift, x / np.linalg.norm(x), EPS * norm)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = np.abs(matrix).max()
    if not scale:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflectors = tridiagonalize(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for i in reversed(range(len(reflectors))):
        v = reflectors[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    return values * scale, vectors
