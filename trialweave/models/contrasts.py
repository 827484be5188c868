"""Contrast codings of categorical predictors."""

from __future__ import annotations

import numpy as np


def treatment(k: int) -> np.ndarray:
    """First level is the reference."""
    return np.eye(k)[:, 1:]


def sum2(k: int) -> np.ndarray:
    """Treatment coding whose first cell is -1: two levels become -1 / +1."""
    c = treatment(k)
    c[0, 0] = -1.0
    return c


def centered_treatment(k: int) -> np.ndarray:
    """Treatment coding minus 1/k in every cell."""
    return treatment(k) - 1.0 / k


def poly(k: int) -> np.ndarray:
    """Orthonormal polynomials over equally spaced levels."""
    x = np.arange(k) - (k - 1) / 2.0
    q, r = np.linalg.qr(np.vander(x, k, increasing=True))
    return (q * np.sign(np.diag(r)))[:, 1:]


CODINGS = {
    "treatment": treatment,
    "sum2": sum2,
    "centered_treatment": centered_treatment,
    "poly": poly,
}


def column_names(name: str, levels, kind: str) -> list[str]:
    if kind == "poly":
        powers = [".L", ".Q", ".C"] + [f"^{i}" for i in range(4, len(levels))]
        return [name + p for p in powers[: len(levels) - 1]]
    return [f"{name}[{level}]" for level in levels[1:]]
