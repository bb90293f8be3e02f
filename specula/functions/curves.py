"""Curves that Spark has no function for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the error function's series, and from where on it is 1 to within 2e-12.
TERMS, FAR = 90, 5.0


def erf(x: Column) -> Column:
    """The error function to about 1e-12.

    The series of exp(x^2) * erf(x) has positive terms only, 2^n / (1 * 3 * ... * (2n + 1)) * x^(2n + 1), so nothing
    cancels; it is folded from its last term.
    """
    near = F.least(F.abs(x), F.lit(FAR))
    square = near * near
    steps = F.lit([2.0 / (2 * n + 1) for n in range(TERMS, 0, -1)])
    total = F.aggregate(steps, F.lit(1.0), lambda acc, c: acc * square * c + 1.0)
    return F.signum(x) * F.when(F.abs(x) >= FAR, 1.0).otherwise(near * total * F.exp(-square) * (2 / math.sqrt(math.pi)))


def erf_step(x: Column, centre: float, width: float) -> Column:
    """From 0 to 1 about ``centre``; from 1 to 0 if ``width`` is negative."""
    return erf((x - centre) / width) * 0.5 + 0.5


def band_pass(x: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    """What two filters let through, one closed below and one above: each an amplitude within 0 to 1, a place and a width."""
    part = lambda amplitude, at, width: 1 - min(max(amplitude, 0.0), 1.0) * (1 - erf_step(x, at, width))
    return part(*low) * part(high[0], high[1], -high[2])


def dichroic(x: Column, edges: tuple[float, ...], widths: tuple[float, ...], middle: float = 550.0) -> tuple[Column, Column, Column]:
    """Cyan, magenta and yellow filters: cyan closed above the fourth edge, yellow below the first, magenta between the others."""
    up = [erf_step(x, e, w) for e, w in zip(edges, widths, strict=True)]
    return 1 - up[3], F.when(x <= middle, 1 - up[1]).otherwise(up[2]), up[0]
