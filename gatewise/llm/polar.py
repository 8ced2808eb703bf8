"""Eigenvectors of a symmetric matrix by spectral divide and conquer on QDWH polar decompositions.

The orthogonal polar factor of ``A - s I`` has the eigenvectors of A and the signs of its eigenvalues
less s, so ``(U + I) / 2`` projects on the subspace above the shift. An orthonormal basis of that
subspace and of its complement turns A into two blocks without coupling, which are split in turn.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def polar(a: np.ndarray, floor: float = _EPS) -> np.ndarray:
    """Orthogonal polar factor by dynamically weighted Halley steps, each a QR factorisation.

    ``floor`` is a lower bound of the least singular value of ``a`` scaled to norm one; a bound too
    large costs steps, not accuracy, as steps go on until nothing changes.
    """
    n = len(a)
    x, eye = a / max(np.linalg.norm(a), np.finfo(float).tiny), np.eye(n)
    low = floor
    for _ in range(60):
        if low < 1:
            d = np.cbrt(4 * (1 - low * low) / low**4)
            h = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
            h = max(h, 3.0)
        else:
            h = 3.0
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        after = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        change, x = np.linalg.norm(after - x), after
        if change < n * 4 * _EPS and low > 1 - 1e-12:
            break
    return x


def _basis(u: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of the projector ``(u + I) / 2`` and of its complement."""
    n = len(u)
    projector = (u + np.eye(n)) / 2
    start = np.random.default_rng(n).standard_normal((n, n))  # seeded: the same split in every run
    # Two steps of subspace iteration, the second from an orthonormal start.
    first, _ = np.linalg.qr(np.hstack([projector @ start[:, :rank], start[:, rank:] - projector @ start[:, rank:]]))
    upper, _ = np.linalg.qr(projector @ first[:, :rank])
    rest = first[:, rank:] - projector @ first[:, rank:]
    lower, _ = np.linalg.qr(rest - upper @ (upper.T @ rest))
    return upper, lower


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below a shift between two eigenvalues."""
    n = len(a)
    inside = np.diag(a)
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    # The median halves the work, the mean always has eigenvalues on both sides, the others step aside
    # where a shift happens to be an eigenvalue.
    for shift in (np.median(inside), centre, *(centre + f * spread / n for f in (0.25, -0.25, 0.5, -0.5, 0.05, -0.05))):
        u = polar((a - shift * np.eye(n)), _EPS)
        rank = round((np.trace(u) + n) / 2)
        if not 0 < rank < n:
            continue
        upper, lower = _basis(u, rank)
        if np.linalg.norm(upper.T @ a @ lower) <= 64 * n * _EPS * max(spread, _EPS * abs(centre)):
            return upper, lower
    return None


def _settle(values: np.ndarray, vectors: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns pairs of vectors until ``a`` is diagonal among them, for what rounding, or a cluster no shift splits, left."""
    for _ in range(30):
        inner = vectors.T @ a @ vectors
        inner = (inner + inner.T) / 2
        off = inner - np.diag(np.diag(inner))
        if np.abs(off).max(initial=0) <= 2 * _EPS * max(np.abs(np.diag(inner)).max(initial=0), np.finfo(float).tiny):
            break
        for i, j in zip(*np.nonzero(np.triu(np.abs(off) > _EPS * np.sqrt(np.abs(np.outer(np.diag(inner), np.diag(inner)))), 1))):
            vi, vj = vectors[:, i].copy(), vectors[:, j].copy()
            ii, jj, ij = vi @ a @ vi, vj @ a @ vj, vi @ a @ vj
            if ij == 0:
                continue
            theta = 0.5 * np.arctan2(2 * ij, ii - jj)
            if theta > np.pi / 4:
                theta -= np.pi / 2
            elif theta < -np.pi / 4:
                theta += np.pi / 2
            c, s = np.cos(theta), np.sin(theta)
            vectors[:, i], vectors[:, j] = c * vi + s * vj, c * vj - s * vi
    return np.einsum("ij,ij->j", vectors, a @ vectors), vectors


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(n), np.eye(n)
    a = (a + a.T) / (2 * scale)

    def parts(basis: np.ndarray):
        if basis.shape[1] == 1:
            yield basis
            return
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        found = _split(inner)
        if found is None:  # one eigenvalue many times over: every basis will do
            yield basis
            return
        for part in found:
            yield from parts(basis @ part)

    vectors = np.hstack(list(parts(np.eye(n))))
    vectors /= np.linalg.norm(vectors, axis=0)
    values, vectors = _settle(np.zeros(n), vectors, a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    return values[order] * scale, vectors
