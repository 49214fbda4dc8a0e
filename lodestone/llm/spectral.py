"""Eigenvectors of one small symmetric matrix by spectral divide and conquer.

The polar factor of ``A - shift`` has the eigenvalues +1 and -1: it tells the
eigenvectors above the shift from those below. Half of it plus one is the projector onto
the first kind; orthonormal bases of both subspaces split the matrix into two smaller
ones, which are split again. Polar factors come from the dynamically weighted Halley
iteration in its inverse-free form, a QR decomposition a step.

The matrix is a covariance: its size is the dimension of a vector, never a number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
MOST_STEPS = 12
#: a projector's trace is a whole number, up to rounding
_TRACE_SLACK = 1e-6


def polar_factor(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix; None if the matrix is too near a singular one."""
    n = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return None
    x, low, eye = a / scale, EPS, np.eye(n)
    for _ in range(MOST_STEPS):
        square = min(1.0, low * low)
        gamma = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = np.sqrt(1 + gamma)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * gamma + 8 * (2 - square) / (square * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (p + q * square) / (1 + r * square))
        if moved <= (5 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x if np.linalg.norm(x @ x - eye) <= 1e-10 * n else None


def _shifts(a: np.ndarray):
    """The mean eigenvalue, then points around it: some lie between two eigenvalues."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    yield mean
    for k in range(1, 4 * n + 4):
        step = spread * k / (8 * n + 8)
        yield mean + step
        yield mean - step


def subspaces(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenspaces above and below some shift."""
    n = len(a)
    for shift in _shifts(a):
        sign = polar_factor(a - shift * np.eye(n))
        if sign is None:
            continue
        projector = (sign + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n or abs(np.trace(projector) - rank) > _TRACE_SLACK:
            continue
        span, _ = np.linalg.qr(projector @ rng.standard_normal((n, rank)))
        whole, _ = np.linalg.qr(projector @ span, mode="complete")
        return whole[:, :rank], whole[:, rank:]
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    A vector's entry of largest magnitude is positive, so that equal matrices give equal
    vectors. Equal eigenvalues give some orthonormal basis of their space.
    """
    a = (a + a.T) / 2
    n, rng = len(a), np.random.default_rng(0)
    small = EPS * np.linalg.norm(a)
    vectors: list[np.ndarray] = []
    todo = [np.eye(n)] if n else []
    while todo:
        basis = todo.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        off = part - np.diag(np.diag(part))
        split = subspaces(part, rng) if len(part) > 1 and np.linalg.norm(off) > small else None
        if split is None:
            vectors.append(basis)
        else:
            todo += [basis @ half for half in split]
    if not vectors:
        return np.zeros(0), np.zeros((0, 0))
    found = np.hstack(vectors)
    found = found / np.linalg.norm(found, axis=0)
    values = np.einsum("ij,ij->j", found, a @ found)
    order = np.argsort(-values, kind="stable")
    values, found = values[order], found[:, order]
    heads = found[np.abs(found).argmax(axis=0), np.arange(n)]
    return values, found * np.where(heads < 0, -1.0, 1.0)
