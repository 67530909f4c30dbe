"""Description lengths as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: normaliser of the universal code of the integers.
INTEGER_NORM = 2.865064


def bic(n: Column, log2: bool = False) -> Column:
    return 0.5 * (F.log2(n) if log2 else F.log(n))


def integer(n: Column, log2: bool = False) -> Column:
    """Universal code length: iterated logarithms while positive (six reach any number)."""
    log = F.log2 if log2 else F.log
    total, term = F.lit(math.log2(INTEGER_NORM) if log2 else math.log(INTEGER_NORM)), n.cast("double")
    for _ in range(6):
        term = F.when(term > 0, log(term))
        total = total + F.when(term > 0, term).otherwise(0.0)
        term = F.when(term > 0, term)
    return total


def probability(p: Column) -> Column:
    return F.when(p == 0, 0.0).otherwise(-F.log2(p))


def spherical_gaussian(n: Column, dims: Column, trace: Column) -> Column:
    """Bits for n points of a spherical Gaussian with the given scatter trace; 0 where there is nothing to code."""
    bits = n * dims / (2 * math.log(2)) * (1 + math.log(2 * math.pi) - F.log(dims * n) + F.log(trace))
    return F.when((n <= 1) | (dims == 0) | (trace <= 1e-15), 0.0).otherwise(bits)
