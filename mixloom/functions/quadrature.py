"""Quadrature rules for normal integrals in one and several dimensions."""

from __future__ import annotations

from itertools import product

import numpy as np


def gauss_hermite(n: int) -> np.ndarray:
    """Rows (z, w, log of the normal density at z) of n nodes, 0 to 100, symmetric, weights summing to one."""
    if not 0 <= n <= 100:
        raise ValueError("from 0 to 100 nodes")
    if n == 0:
        return np.zeros((0, 3))
    z, w = np.polynomial.hermite_e.hermegauss(n)
    z, w = (z - z[::-1]) / 2, (w + w[::-1]) / 2
    w = w / w.sum()
    return np.column_stack([z, w, -0.5 * (z * z + np.log(2 * np.pi))])


def sparse_grid(d: int, k: int) -> np.ndarray:
    """Rows (weight, z_1..z_d) of the sparse grid of order k for d normal variables: exact for polynomials of total degree 2k - 1.

    Differences of one-dimensional rules are combined over all levels that sum to at most k + d - 1; equal points are merged.
    """
    from math import comb

    points: dict[tuple, float] = {}
    for levels in product(range(1, k + 1), repeat=d):
        q = k + d - 1 - sum(levels)
        if not 0 <= q <= d - 1:
            continue
        sign = (-1) ** q * comb(d - 1, q)
        rules = [gauss_hermite(n) for n in levels]
        for at in product(*(range(len(r)) for r in rules)):
            z = tuple(round(float(r[i, 0]), 12) + 0.0 for r, i in zip(rules, at, strict=True))
            points[z] = points.get(z, 0.0) + sign * float(np.prod([r[i, 1] for r, i in zip(rules, at, strict=True)]))
    rows = [(w, *z) for z, w in sorted(points.items()) if abs(w) > 1e-15]
    return np.array(rows)
