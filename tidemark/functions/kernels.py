"""Spatial kernels of the squared lateral and axial distance and one or two widths, as Column expressions or on numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F


class _Arrays:
    """The functions that kernels use, on numpy arrays."""

    sqrt, exp, pow = staticmethod(np.sqrt), staticmethod(np.exp), staticmethod(np.power)

    @staticmethod
    def lit(x: float) -> float:
        return x


ARRAYS = _Arrays()
Kernel = Callable[..., object]


def _monopole(r2, z2, a, b, f=F):
    return a / f.sqrt(r2 + z2 + a * a)


KERNELS: dict[str, Kernel] = {
    "monopole": _monopole,
    "gauss": lambda r2, z2, a, b, f=F: f.exp(-(r2 + z2) / (2 * a * a)),
    "exp": lambda r2, z2, a, b, f=F: f.exp(-f.sqrt(r2 + z2) / a),
    "lorentz": lambda r2, z2, a, b, f=F: a * a / (r2 + z2 + a * a),
    "power": lambda r2, z2, a, b, f=F: f.pow(a / f.sqrt(r2 + z2 + a * a), f.lit(b)),
    "student": lambda r2, z2, a, b, f=F: f.pow(1 + (r2 + z2) / (a * a), f.lit(-b)),
    "yukawa": lambda r2, z2, a, b, f=F: _monopole(r2, z2, a, b, f) * f.exp(-f.sqrt(r2 + z2 + 1e-6) / b),
    "gauss_aniso": lambda r2, z2, a, b, f=F: f.exp(-(r2 / (2 * a * a) + z2 / (2 * b * b))),
    "mono_aniso": lambda r2, z2, a, b, f=F: a / f.sqrt(r2 + z2 * (a / b) ** 2 + a * a),
    "dog": lambda r2, z2, a, b, f=F: f.exp(-(r2 + z2) / (2 * a * a)) - f.exp(-(r2 + z2) / (2 * (a * b) ** 2)) / (b * b),
}
#: Widths that a profile of the kernel is made of: one, a width and a shape, or one for each direction.
ONE, SHAPED, DIRECTED = "one", "shaped", "directed"
WIDTHS = {k: DIRECTED if k.endswith("_aniso") else SHAPED if k in ("power", "student", "yukawa", "dog") else ONE for k in KERNELS}


def evaluate(name: str, r2: np.ndarray, z2: np.ndarray, a: float, b: float) -> np.ndarray:
    """The kernel on arrays; the same formulas as the Column expressions."""
    return KERNELS[name](r2, z2, a, b, ARRAYS)
