"""Three-dimensional tables over colours: lattices, interpolation between their points, and cube text.

A table has n^3 points, red running fastest. It is small and fixed, so its values are constants of the plan, folded
once, and rows are mapped where they are: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """k, ir, ig, ib and r, g, b in 0 to 1 of all points."""
    df = spark.range(n**3).withColumnRenamed("id", "k")
    at = {"ir": F.col("k") % n, "ig": F.call_function("div", F.col("k"), F.lit(n)) % n, "ib": F.call_function("div", F.col("k"), F.lit(n * n))}
    return df.withColumns({name: c.cast("int") for name, c in at.items()}).withColumns({c: F.col(f"i{c}") / float(n - 1) for c in "rgb"})


def baked(n: int, f: Callable) -> list[Column]:
    """Values of f(r, g, b) at all points as three constant arrays."""
    step = 1.0 / (n - 1)
    points = [f((k % n) * step, (k // n % n) * step, (k // (n * n)) * step) for k in range(n**3)]
    return [F.lit([float(p[c]) for p in points]) for c in range(3)]


def _cell(x: Column, n: int) -> tuple[Column, Column]:
    at = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (n - 1)
    base = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    return base, at - base


def trilinear(table: Column, n: int, r: Column, g: Column, b: Column) -> Column:
    (i, fr), (j, fg), (k, fb) = (_cell(c, n) for c in (r, g, b))
    value = lambda di, dj, dk: F.get(table, (i + di) + (j + dj) * n + (k + dk) * (n * n))
    mix = lambda low, high, t: low + (high - low) * t
    rows = [[mix(value(0, dj, dk), value(1, dj, dk), fr) for dj in (0, 1)] for dk in (0, 1)]
    return mix(*(mix(*row, fg) for row in rows), fb)


def with_tetrahedra(df: DataFrame, n: int) -> DataFrame:
    """``df`` (r, g, b) with the four points of the tetrahedron that holds each colour (``_p``) and their weights (``_w``).

    The largest of the three fractions leads the way from the cell's first corner, the least comes last.
    """
    cells = {c: _cell(F.col(c), n) for c in "rgb"}
    out = df.withColumns({"_at": sum(cells[c][0] * n**k for k, c in enumerate("rgb")), **{f"_{c}": cells[c][1] for c in "rgb"}})
    r, g, b = (F.col(f"_{c}") for c in "rgb")
    first = F.when((r >= g) & (r >= b), 1).when(g >= b, n).otherwise(n * n)
    last = F.when((b <= r) & (b <= g), n * n).when(g <= r, n).otherwise(1)
    out = out.withColumns({"_first": first, "_last": last, "_hi": F.greatest(r, g, b), "_lo": F.least(r, g, b)})
    hi, lo, whole = F.col("_hi"), F.col("_lo"), 1 + n + n * n
    mid = r + g + b - hi - lo
    points = F.array(F.col("_at"), F.col("_at") + F.col("_first"), F.col("_at") + (whole - F.col("_last")), F.col("_at") + whole)
    out = out.withColumns({"_p": points, "_w": F.array(1 - hi, hi - mid, mid - lo, lo)})
    return out.drop("_at", "_r", "_g", "_b", "_first", "_last", "_hi", "_lo")


def tetrahedral(table: Column) -> Column:
    """The table's value at a colour, from the columns of :func:`with_tetrahedra`."""
    return sum(F.get(table, F.get("_p", F.lit(k))) * F.get("_w", F.lit(k)) for k in range(4))


def limited_slopes(v: np.ndarray, axis: int) -> np.ndarray:
    """Slopes by which cubics between the points of each line along ``axis`` keep to the points' rises and falls.

    Inside, the harmonic mean of both differences, or 0 where they don't agree; at an end the three-point slope, 0 if it
    is against the first difference and no more than three times that where the line turns.
    """
    v = np.moveaxis(np.asarray(v, float), axis, 0)
    if len(v) == 1:
        return np.moveaxis(np.zeros_like(v), 0, axis)
    d = np.diff(v, axis=0)
    if len(d) == 1:
        return np.moveaxis(np.concatenate([d, d]), 0, axis)
    before, after = d[:-1], d[1:]
    agree = before * after > 0
    inside = np.where(agree, 2 * before * after / np.where(agree, before + after, 1.0), 0.0)

    def end(near, far):
        out = 1.5 * near - 0.5 * far
        out = np.where((near * far < 0) & (np.abs(out) > 3 * np.abs(near)), 3 * near, out)
        return np.where((1.5 * near - 0.5 * far) * near > 0, out, 0.0)

    return np.moveaxis(np.concatenate([end(d[0], d[1])[None], inside, end(d[-1], d[-2])[None]]), 0, axis)


def with_cells(df: DataFrame, n: int) -> DataFrame:
    """``df`` (r, g, b) with the first corner of each colour's cell (``_at``) and, for each axis, the weights of a cubic
    there: of the two ends (``_r0``, ``_r1``) and of their slopes (``_r2``, ``_r3``), and the share of the way (``_rt``)."""
    cells = {c: _cell(F.col(c), n) for c in "rgb"}
    out = df.withColumns({"_at": sum(cells[c][0] * n**k for k, c in enumerate("rgb")), **{f"_{c}t": cells[c][1] for c in "rgb"}})
    for c in "rgb":
        t = F.col(f"_{c}t")
        out = out.withColumns({f"_{c}0": (2 * t + 1) * (1 - t) * (1 - t), f"_{c}1": t * t * (3 - 2 * t), f"_{c}2": t * (1 - t) * (1 - t), f"_{c}3": t * t * (t - 1)})
    return out


def monotone_cubic(df: DataFrame, n: int, tables: dict[str, list[float]]) -> DataFrame:
    """``df`` (r, g, b) with a column for each of ``tables``, interpolated by monotone cubics along red, green and blue.

    Slopes of all points along each axis are constants of the plan. The slopes for the second axis are mixed linearly
    along the first, those for the third along both, and the result keeps within its cell's corners.
    """
    out = with_cells(df, n)
    corner = [di + dj * n + dk * n * n for dk in (0, 1) for dj in (0, 1) for di in (0, 1)]
    for name, values in tables.items():
        cube = np.reshape(values, (n, n, n))  # blue, green, red
        arrays = [cube, limited_slopes(cube, 2), limited_slopes(cube, 1), limited_slopes(cube, 0)]
        for k, a in enumerate(arrays):
            lit = F.lit([float(x) for x in a.ravel()])
            out = out.withColumn(f"_c{k}", F.array(*[F.get(lit, (F.col("_at") + d).cast("int")) for d in corner]))
        at = lambda k, c: F.get(f"_c{k}", F.lit(c))
        mix = lambda a, b, t: a + (b - a) * t
        cubic = lambda a, b, sa, sb, c: a * F.col(f"_{c}0") + b * F.col(f"_{c}1") + sa * F.col(f"_{c}2") + sb * F.col(f"_{c}3")
        lines = [cubic(at(0, c), at(0, c + 1), at(1, c), at(1, c + 1), "r") for c in (0, 2, 4, 6)]
        second = [mix(at(2, c), at(2, c + 1), F.col("_rt")) for c in (0, 2, 4, 6)]
        third = [mix(at(3, c), at(3, c + 1), F.col("_rt")) for c in (0, 2, 4, 6)]
        out = out.withColumns({"_f0": cubic(lines[0], lines[1], second[0], second[1], "g"), "_f1": cubic(lines[2], lines[3], second[2], second[3], "g"), "_s0": mix(third[0], third[1], F.col("_gt")), "_s1": mix(third[2], third[3], F.col("_gt"))})
        value = cubic(F.col("_f0"), F.col("_f1"), F.col("_s0"), F.col("_s1"), "b")
        out = out.withColumn(f"_out_{name}", F.least(F.greatest(value, F.array_min("_c0")), F.array_max("_c0")))
    return out.select(*df.columns, *[F.col(f"_out_{name}").alias(f"{name}_out") for name in tables])
