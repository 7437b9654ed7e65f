"""Constants of the Gauss-Lobatto-Legendre (GLL) basis.

The tables depend on the number of nodes only (a few hundred doubles), so they
are computed once per process and travel inside the closures of the Arrow
kernels.  Everything is expressed through the Legendre modes: with
``V[i, k] = P_k(x_i)`` the Lagrange basis at any points ``t`` is
``legvander(t) @ V^-1``, which needs no special treatment of the nodes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.polynomial import legendre as leg


def _frozen(a: np.ndarray) -> np.ndarray:
    a = np.ascontiguousarray(a, dtype=float)
    a.setflags(write=False)
    return a


@lru_cache(maxsize=None)
def nodes(n: int) -> np.ndarray:
    """The ``n`` GLL nodes: -1, the roots of ``P'_{n-1}``, and +1."""
    if n < 2:
        raise ValueError("a GLL rule has at least two nodes")
    p = leg.Legendre.basis(n - 1)
    d1, d2 = p.deriv(), p.deriv(2)
    inner = np.sort(np.real(d1.roots())) if n > 2 else np.empty(0)
    for _ in range(3):
        inner = inner - d1(inner) / d2(inner)
    inner = 0.5 * (inner - inner[::-1])  # the rule is symmetric about 0
    return _frozen(np.concatenate([[-1.0], inner, [1.0]]))


@lru_cache(maxsize=None)
def weights(n: int) -> np.ndarray:
    """Quadrature weights ``2 / (n (n-1) P_{n-1}(x)^2)``."""
    return _frozen(2.0 / (n * (n - 1) * leg.Legendre.basis(n - 1)(nodes(n)) ** 2))


@lru_cache(maxsize=None)
def vandermonde(n: int) -> np.ndarray:
    """``V[i, k] = P_k(x_i)``."""
    return _frozen(leg.legvander(nodes(n), n - 1))


@lru_cache(maxsize=None)
def modal_matrix(n: int) -> np.ndarray:
    """``V^-1``: nodal values to Legendre coefficients."""
    return _frozen(np.linalg.inv(vandermonde(n)))


@lru_cache(maxsize=None)
def derivative_matrix(n: int) -> np.ndarray:
    """``D`` with ``(D f)_i = f'(x_i)``, from the closed form for GLL nodes."""
    x, p = nodes(n), leg.Legendre.basis(n - 1)(nodes(n))
    gap = x[:, None] - x[None, :] + np.eye(n)
    d = (p[:, None] / p[None, :]) / gap
    np.fill_diagonal(d, 0.0)
    d[np.diag_indices(n)] = -d.sum(axis=1)
    return _frozen(d)


def lagrange(n: int, t) -> np.ndarray:
    """All basis polynomials at ``t``: shape ``t.shape + (n,)``."""
    return leg.legvander(np.asarray(t, dtype=float), n - 1) @ modal_matrix(n)


def uniform_points(m: int) -> np.ndarray:
    """``m`` equispaced points on [-1, 1], ends included."""
    return np.linspace(-1.0, 1.0, m)


def cell_centres(m: int) -> np.ndarray:
    """Midpoints of ``m`` equal cells of [-1, 1]."""
    return (2.0 * np.arange(m) + 1.0) / m - 1.0


#: target points of the resampling kinds
TARGETS = {"uniform": uniform_points, "gll": nodes, "cell_centers": cell_centres}


@lru_cache(maxsize=None)
def resample_matrix(n: int, m: int, kind: str = "uniform") -> np.ndarray:
    """``m x n`` interpolation matrix from ``n`` GLL nodes to ``m`` points of ``kind``."""
    if kind not in TARGETS:
        raise ValueError(f"unknown point set {kind!r}; choose from {sorted(TARGETS)}")
    return _frozen(lagrange(n, TARGETS[kind](m)))
