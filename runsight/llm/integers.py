"""Vectors of floating-point components as vectors of integers, whose products and distances are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component's integer is floor(SCALE * component).
SCALE = 256
#: Components from here on take no part: with fewer, squares of up to 128 differences fit a long.
MOST = float(1 << 19)


def usable(vector: Column, most: float = MOST) -> Column:
    """Whether a vector is there, has components and holds none that is null, NaN, infinite or most or more in size."""
    # NaN counts as larger than any number in comparisons
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < most, F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("int"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and of b, int64. By floating point where all sums are below 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
