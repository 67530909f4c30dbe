"""Description lengths of model parameters and Gaussian clusters, as numbers, and small linear algebra."""

from __future__ import annotations

import math

import numpy as np

from quillon.functions.costs import INTEGER_NORM

LN2 = math.log(2)


def bic_costs(n: float, log2: bool = False) -> float:
    if n <= 1:
        raise ValueError("needs more than one point")
    return 0.5 * (math.log2(n) if log2 else math.log(n))


def integer_costs(n: int, log2: bool = False) -> float:
    """Universal code length: iterated logarithms while positive."""
    log = math.log2 if log2 else math.log
    total, term = log(INTEGER_NORM), float(n)
    while term > 0 and (term := log(term)) > 0:
        total += term
    return total


def probability_costs(p: float) -> float:
    return 0.0 if p == 0 else -math.log2(p)


def _turned(scatter: np.ndarray, rotation: np.ndarray | None) -> np.ndarray:
    return scatter if rotation is None else rotation.T @ scatter @ rotation


def gaussian_costs(dims: int, scatter: np.ndarray, n: int, rotation: np.ndarray | None = None, kind: str = "spherical") -> float:
    """Bits for n points of one Gaussian with the given scatter matrix; 0 where there is nothing to code."""
    if kind not in ("spherical", "diag", "full"):
        raise ValueError("kind is spherical, diag or full")
    if n <= 1 or dims == 0:
        return 0.0
    s = _turned(scatter, rotation)
    if kind == "spherical":
        trace = float(np.trace(s))
        return 0.0 if trace <= 1e-15 else n * dims / (2 * LN2) * (1 + math.log(2 * math.pi) - math.log(dims * n) + math.log(trace))
    if kind == "diag":
        var = np.diag(s) / n
        var = var[var > 1e-15]
        return float(n / (2 * LN2) * (len(var) * (1 + math.log(2 * math.pi)) + np.log(var).sum()))
    sign, log_det = np.linalg.slogdet(s / n)
    log_det = log_det if sign > 0 else math.log(1e-20)
    return float(n / (2 * LN2) * (dims * (1 + math.log(2 * math.pi)) + log_det))


def mixture_costs(dims: int, scatters, sizes, rotation: np.ndarray | None = None, kind: str = "spherical") -> float:
    """Bits for clusters with a covariance each; ``sizes``: their points."""
    return sum(gaussian_costs(dims, s, int(n), rotation, kind) for s, n in zip(scatters, sizes))


def common_costs(dims: int, scatter: np.ndarray, n: int, rotation: np.ndarray | None = None, kind: str = "spherical") -> float:
    """Bits for clusters that share one covariance; ``scatter`` is their sum."""
    return gaussian_costs(dims, scatter, n, rotation, kind)


def generalised_eigen(a: np.ndarray, b: np.ndarray, ridge: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Values, largest first, and vectors of a v = w b v for symmetric a and positive b, whitened by a Cholesky factor."""
    scale = max(float(np.trace(b)) / max(len(b), 1), 1e-300)
    low = np.linalg.cholesky(b + ridge * scale * np.eye(len(b)))
    half = np.linalg.solve(low, np.linalg.solve(low, a).T)
    w, v = np.linalg.eigh((half + half.T) / 2)
    return w[::-1], np.linalg.solve(low.T, v)[:, ::-1]


def is_orthogonal(m: np.ndarray, tolerance: float = 1e-6) -> bool:
    return m.shape[0] == m.shape[1] and np.allclose(m @ m.T, np.eye(len(m)), atol=tolerance)


def is_symmetric(m: np.ndarray, tolerance: float = 1e-6) -> bool:
    return m.shape[0] == m.shape[1] and np.allclose(m, m.T, atol=tolerance)
